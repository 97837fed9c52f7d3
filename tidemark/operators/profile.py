"""Descriptive statistics of series, their breaks, and which series are related."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.causal import series
from .scoring import BUCKETS

LAGS = (1, 2, 5, 10, 20)
QUANTILES = {"q01": 0.01, "q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}
#: Quantiles of a distribution table.
TABLE = {"min": 0.0, "p1": 0.01, "p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "max": 1.0}
NEAR_RMS = 0.01
BINS = 16
BLOCK = 128


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def series_statistics(df: DataFrame, value: str = "value", order: str = "k") -> DataFrame:
    """One row a series: length, nonfinite, mean, std, median, mad, quantiles, population skewness and excess
    kurtosis (from 8 values), share of robust outliers, slope, variance of differences.

    Non-finite values are counted and left out; a slope is per place in the full series.
    """
    v = F.when(_finite(F.col(value)), F.col(value).cast("double"))
    d = df.select("id", (F.row_number().over(series().orderBy(order)) - 1).cast("double").alias("pos"), v.alias("x"))
    d = d.withColumns({"med": F.percentile("x", F.lit(0.5)).over(series()), "mean": F.avg("x").over(series()), "dx": F.col("x") - F.lag("x").over(series().orderBy("pos"))})
    d = d.withColumns({"dev": F.abs(F.col("x") - F.col("med")), "c": F.col("x") - F.col("mean")})
    d = d.withColumn("mad", F.percentile("dev", F.lit(0.5)).over(series()))
    out = F.when((F.col("mad") > 0) & F.col("x").isNotNull(), (F.col("dev") > 5 * 1.4826 * F.col("mad")).cast("double"))
    p = F.when(F.col("x").isNotNull(), F.col("pos"))
    g = d.groupBy("id").agg(
        F.count(F.lit(1)).alias("length"), (F.count(F.lit(1)) - F.count("x")).alias("nonfinite"), F.count("x").alias("_n"),
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.first("med").alias("median"), F.first("mad").alias("mad"),
        (F.min("x") == F.max("x")).cast("int").alias("constant"), (F.first("mad") == 0).cast("int").alias("zero_mad"),
        F.percentile("x", F.array(*[F.lit(q) for q in QUANTILES.values()])).alias("_q"),
        F.avg(F.pow("c", 2)).alias("_m2"), F.avg(F.pow("c", 3)).alias("_m3"), F.avg(F.pow("c", 4)).alias("_m4"),
        F.avg(out).alias("extreme_fraction"), F.covar_pop(p, F.col("x")).alias("_cov"), F.var_pop(p).alias("_vp"), F.var_samp("dx").alias("difference_variance"),
    )
    many = (F.col("_n") >= 8) & (F.col("_m2") > 0)
    slope = F.when(F.col("_n") >= 2, F.try_divide("_cov", "_vp"))
    return g.select(
        "id", "length", "nonfinite", "mean", "std", "median", "mad", "constant", "zero_mad",
        *[F.get("_q", i).alias(q) for i, q in enumerate(QUANTILES)],
        F.when(many, F.col("_m3") / F.pow("_m2", 1.5)).alias("skewness"), F.when(many, F.col("_m4") / F.pow("_m2", 2) - 3).alias("excess_kurtosis"),
        "extreme_fraction", slope.alias("slope_per_tick"), F.when(F.col("std") > 0, slope * F.col("length") / F.col("std")).alias("slope_times_length_over_sd"),
        "difference_variance",
    )


TRANSFORMS = ("acf", "abs_acf", "squared_acf", "centered_abs_acf", "centered_squared_acf")


def autocorrelations(df: DataFrame, value: str = "value", order: str = "k", lags: tuple[int, ...] = LAGS) -> DataFrame:
    """id and <transform>_<lag>: correlations over pairs of finite values, null under four pairs or without variance."""
    d = df.select("id", order, F.when(_finite(F.col(value)), F.col(value).cast("double")).alias("x"))
    d = d.withColumns({"med": F.percentile("x", F.lit(0.5)).over(series()), "mean": F.avg("x").over(series())})
    made = {"acf": F.col("x"), "abs_acf": F.abs("x"), "squared_acf": F.col("x") * F.col("x"), "centered_abs_acf": F.abs(F.col("x") - F.col("med")), "centered_squared_acf": F.pow(F.col("x") - F.col("mean"), 2)}
    d = d.select("id", order, *[c.alias(n) for n, c in made.items()])
    d = d.withColumns({f"{n}_{g}": F.lag(n, g).over(series().orderBy(order)) for n in made for g in lags})
    aggs = []
    for n in made:
        for g in lags:
            a, b = F.col(f"{n}_{g}"), F.when(F.col(f"{n}_{g}").isNotNull(), F.col(n))
            both = F.count(F.when(a.isNotNull() & b.isNotNull(), 1))
            aa = F.when(b.isNotNull(), a)
            r = F.try_divide(F.covar_pop(aa, b), F.sqrt(F.var_pop(aa) * F.var_pop(b)))
            aggs.append(F.when(both >= 4, r).alias(f"{n}_{g}"))
    return d.groupBy("id").agg(*aggs)


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """statistic, count, valid, nonfinite, quantiles, mean over the rows of df, a row for each column."""
    long = df.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("statistic", "v"))
    x = F.when(_finite(F.col("v")), F.col("v"))
    g = long.groupBy("statistic").agg(F.count(F.lit(1)).alias("count"), F.count(x).alias("valid"), F.percentile(x, F.array(*[F.lit(q) for q in TABLE.values()])).alias("_q"), F.avg(x).alias("mean"))
    return g.select("statistic", "count", "valid", (F.col("count") - F.col("valid")).alias("nonfinite"), *[F.get("_q", i).alias(n) for i, n in enumerate(TABLE)], "mean")


def signature(df: DataFrame, window: int | None = None, fewest: int = 8) -> DataFrame:
    """How a series' values after its break differ from its reference, a row for each series with a break.

    Without window the reference is the history and what follows is all rows from
    the break on; with one, both sides hold the min(window, available) online
    rows next to the break, at least fewest.
    """
    d = df.filter("tau_index >= 0").select("id", "k", "t", "period", "tau_index", "value")
    if window:
        o = d.filter("period = 2")
        o = o.withColumn("width", F.least(F.lit(window), F.col("tau_index"), F.max("t").over(series()) + 1 - F.col("tau_index"))).filter(F.col("width") >= fewest)
        gap = F.col("t") - F.col("tau_index")
        o = o.withColumn("side", F.when((gap < 0) & (gap >= -F.col("width")), "a").when((gap >= 0) & (gap < F.col("width")), "b"))
    else:
        o = d.withColumn("side", F.when(F.col("period") == 1, "a").when(F.col("t") >= F.col("tau_index"), "b"))
    o = o.filter("side is not null")
    # each side is a series of its own
    sides = o.select(F.struct("id", "side").alias("id"), "k", "value")
    s = series_statistics(sides).join(autocorrelations(sides).select("id", *[f"acf_{g}" for g in LAGS]), "id")
    names = [c for c in s.columns if c != "id"]
    a = s.filter("id.side = 'a'").select(F.col("id.id").alias("sid"), *[F.col(c).alias(f"a_{c}") for c in names])
    b = s.filter("id.side = 'b'").select(F.col("id.id").alias("sid"), *[F.col(c).alias(f"b_{c}") for c in names])
    j = a.join(b, "sid")
    limits = df.filter("period = 1").groupBy(F.col("id").alias("sid")).agg(F.percentile("value", F.lit(0.01)).alias("lo"), F.percentile("value", F.lit(0.99)).alias("hi"))
    tail = o.join(limits, o["id"] == limits["sid"]).groupBy("sid").agg(*[F.avg(F.when(F.col("side") == s_, ((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))).cast("double"))).alias(f"tail_{s_}") for s_ in "ab"])
    j = j.join(tail, "sid")
    per = lambda c: F.when(F.col("a_std") > 0, (F.col(f"b_{c}") - F.col(f"a_{c}")) / F.col("a_std"))
    return j.select(
        F.col("sid").alias("id"), F.col("a_length").alias("reference_length"), F.col("b_length").alias("post_length"),
        per("mean").alias("mean_change"), *[per(q).alias(f"{q}_change") for q in QUANTILES],
        F.when((F.col("a_std") > 0) & (F.col("b_std") > 0), 2 * F.ln(F.col("b_std") / F.col("a_std"))).alias("log_variance_ratio"),
        F.when((F.col("a_mad") > 0) & (F.col("b_mad") > 0), F.ln(F.col("b_mad") / F.col("a_mad"))).alias("log_mad_ratio"),
        *[(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"{c}_change") for c in ("skewness", "excess_kurtosis", *[f"acf_{g}" for g in LAGS])],
        (F.col("tail_b") - F.col("tail_a")).alias("tail_frequency_change"),
    )


def whitening(df: DataFrame) -> DataFrame:
    """By series, for autoregressions of order 1 and 5 fitted on the history's first part: residual over raw
    variance and mean square on its rest, residual standard deviation and lag-one correlation, and the
    coefficients' change between the history's halves.
    """
    from .blocks import autoregression, fit_rows, ref_rows

    past = df.filter("period = 1").withColumn("half", F.floor(F.col("H") / 2))
    out = None
    for p in (1, 5):
        fitted = autoregression(past, p, fit_rows(), "c")
        c = fitted.filter(ref_rows()).withColumn("e1", F.lag("e").over(series().orderBy("k")))
        g = c.groupBy("id").agg(
            (F.var_pop("e") / F.var_pop("az")).alias(f"ar{p}_variance_ratio"), (F.avg(F.col("e") * F.col("e")) / F.avg(F.col("az") * F.col("az"))).alias(f"ar{p}_mse_ratio"),
            F.stddev_samp("e").alias(f"ar{p}_residual_std"), F.corr("e", "e1").alias(f"ar{p}_residual_acf_1"), *[F.first(f"c{i}").alias(f"ar{p}_coefficient_{i}") for i in range(p + 1)],
        )
        one = lambda cond, n: autoregression(past.filter(cond), p, F.col("period") == 1, n).groupBy("id").agg(*[F.first(f"{n}{i}").alias(f"{n}{i}") for i in range(1, p + 1)])  # noqa: E731, B023
        halves = one(F.col("k") < F.col("half"), "h").join(one(F.col("k") >= F.col("half"), "g"), "id")
        change = F.sqrt(sum((F.pow(F.col(f"h{i}") - F.col(f"g{i}"), 2) for i in range(1, p + 1)), F.lit(0.0)))
        g = g.join(halves.select("id", change.alias(f"ar{p}_half_change")), "id")
        out = g if out is None else out.join(g, "id")
    return out


def age_support(df: DataFrame) -> DataFrame:
    """By age: active, positive, negative rows and pair weight."""
    g = df.filter("period = 2").groupBy("t").agg(F.count(F.lit(1)).alias("active"), F.sum("target").alias("positive"))
    g = g.withColumn("negative", F.col("active") - F.col("positive"))
    return g.withColumn("weight", F.col("positive") * F.col("negative"))


def break_ages(manifest: DataFrame) -> DataFrame:
    """Breaks by age bucket."""
    age = F.col("tau_index") + 1
    case = None
    for lo, hi in BUCKETS:
        c = (age >= lo) & (age <= hi) if hi else age >= lo
        case = F.when(c, f"{lo}-{hi}" if hi else f"{lo}+") if case is None else case.when(c, f"{lo}-{hi}" if hi else f"{lo}+")
    return manifest.filter("tau_index >= 0").groupBy(case.alias("age_range")).agg(F.count(F.lit(1)).alias("breaks"))


def _digest(df: DataFrame, keys: list[str], order: str, *values: str) -> DataFrame:
    """keys, d (two 64-bit hashes of the ordered values), kinds of the first value, and size; negative zero counts as zero.

    The hashes are sums over rows of hashes of (place, values), so rows are summed where they are.
    """
    first = F.col(order) - F.min(order).over(W.partitionBy(*keys))
    clean = [F.when(F.col(v) == 0, F.lit(0).cast(t)).otherwise(F.col(v)) for v, t in df.dtypes if v in values]
    hashes = [F.xxhash64(F.lit(s), first, *clean).cast("decimal(38,0)") for s in (1, 2)]
    x = df.select(*keys, values[0], *[h.alias(f"_h{i}") for i, h in enumerate(hashes)])
    g = x.groupBy(*keys).agg(*[F.sum(f"_h{i}").alias(f"_h{i}") for i in (0, 1)], F.countDistinct(values[0]).alias("kinds"), F.count(F.lit(1)).alias("size"))
    return g.select(*keys, F.struct("_h0", "_h1", "size").alias("d"), "kinds", "size")


def _same(df: DataFrame, order: str, pairs: DataFrame, *values: str) -> DataFrame:
    """The pairs (id, first) whose rows are equal value by value: what equal hashes only suggest."""
    clean = [F.when(F.col(v) == 0, F.lit(0).cast(t)).otherwise(F.col(v)) for v, t in df.dtypes if v in values]
    row = F.struct(order, *clean)
    a = df.select("id", F.col(order).alias("_o"), row.alias("_a")).join(pairs, "id")
    b = df.select(F.col("id").alias("first"), F.col(order).alias("_o"), row.alias("_b"))
    apart = a.join(b, ["first", "_o"], "left").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("id").distinct()
    return pairs.join(apart, "id", "left_anti")


def _firsts(d: DataFrame) -> DataFrame:
    """id, first, kinds, size for what has the digest of a lesser id."""
    first = d.groupBy("d").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return d.join(first, "d").filter("id <> first").select("id", "first", "kinds", "size")


def duplicate_histories(df: DataFrame) -> DataFrame:
    """id, first: series whose history equals, value by value, that of a series with a lesser id; informative if at least 16 long and 8 values."""
    past = df.filter("period = 1")
    pairs = _same(past, "k", _firsts(_digest(past, ["id"], "k", "value")), "value")
    return pairs.select("id", "first", ((F.col("size") >= 16) & (F.col("kinds") >= 8)).alias("informative"))


def duplicate_series(df: DataFrame) -> DataFrame:
    """id, first: series equal to one of lesser id in values and periods."""
    return _same(df, "k", _firsts(_digest(df, ["id"], "k", "value", "period")), "value", "period").select("id", "first")


def fingerprints(df: DataFrame) -> DataFrame:
    """id, length and BINS means of the standardised history (population sd), bins as even as whole rows allow."""
    h = df.filter("period = 1")
    h = h.withColumns({"m": F.avg("value").over(series()), "s": F.stddev_pop("value").over(series())}).filter("s > 0")
    big, rest = F.floor(F.col("H") / BINS), F.col("H") % BINS
    edge = rest * (big + 1)
    bin_ = F.when(F.col("k") < edge, F.floor(F.col("k") / (big + 1))).otherwise(rest + F.floor(F.try_divide(F.col("k") - edge, big)))
    g = h.filter(f"H >= {BINS}").groupBy("id", F.col("H").alias("length"), bin_.cast("int").alias("bin")).agg(F.avg((F.col("value") - F.col("m")) / F.col("s")).alias("v"))
    return g


def near_candidates(df: DataFrame, limit: float = NEAR_RMS) -> DataFrame:
    """Pairs (a < b) of equally long histories whose fingerprints are as near as an rms of limit between them implies.

    Of two standardised histories within that rms, the means of a bin of n of H values
    differ by limit * sqrt(H / n) at most (Cauchy-Schwarz), and fingerprints weighed by
    their bins' shares by limit at most in all. So neighbouring cells of that width in
    the first four bins hold every such pair, and none is left out.
    """
    f = fingerprints(df).groupBy("id", "length").agg(F.array_sort(F.collect_list(F.struct("bin", "v"))).alias("a")).select("id", "length", F.transform("a", lambda x: x["v"]).alias("f"))
    cell = limit * F.sqrt(F.col("length") / F.floor(F.col("length") / BINS)) * (1 + 1e-9)
    axes = [f"c{i}" for i in range(4)]
    f = f.withColumns({c: F.floor(F.get("f", i) / cell) for i, c in enumerate(axes)})
    near = [F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)])).alias(c) for c in axes]
    b = f.select(F.col("id").alias("b"), "length", F.col("f").alias("g"), *axes)
    for c, e in zip(axes, near, strict=True):
        b = b.select("b", "length", "g", *[x for x in axes if x != c], e)
    d = F.aggregate(F.zip_with("f", "g", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    p = f.join(b, ["length", *axes]).filter("id < b").filter(d * F.floor(F.col("length") / BINS) <= limit * limit * F.col("length") * (1 + 1e-9))
    return p.select(F.col("id").alias("a"), "b").distinct()


def verify_near(df: DataFrame, pairs: DataFrame, limit: float = NEAR_RMS) -> DataFrame:
    """a, b, rms of standardised histories for the pairs within limit."""
    h = df.filter("period = 1")
    z = h.select("id", "k", ((F.col("value") - F.avg("value").over(series())) / F.stddev_pop("value").over(series())).alias("z"))
    x = pairs.join(z.select(F.col("id").alias("a"), "k", F.col("z").alias("za")), "a").join(z.select(F.col("id").alias("b"), "k", F.col("z").alias("zb")), ["b", "k"])
    return x.groupBy("a", "b").agg(F.sqrt(F.avg(F.pow(F.col("za") - F.col("zb"), 2))).alias("rms")).filter(F.col("rms") <= limit)


def repeated_blocks(df: DataFrame) -> DataFrame:
    """a, b, blocks: pairs of series (the first that holds a block, another) and how many aligned blocks they share.

    All blocks of BLOCK rows of a history are compared, by two 64-bit hashes; blocks of under 16 values are left out.
    """
    h = df.filter("period = 1").withColumns({"block": F.floor(F.col("k") / BLOCK).cast("int"), "blocks": F.floor(F.col("H") / BLOCK).cast("int")}).filter("block < blocks")
    d = _digest(h, ["id", "block"], "k", "value").filter("kinds >= 16")
    first = d.groupBy("d").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return d.join(first, "d").filter("id <> a").groupBy("a", F.col("id").alias("b")).agg(F.countDistinct("d").alias("blocks"))
