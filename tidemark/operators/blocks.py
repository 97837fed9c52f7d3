"""Evidence blocks over a series frame: energy, innovations, ranks, sign dependence,
conditional scale, and normal scores. A history's first part (k < cut) fits, its
second, C, gives references; both are frozen before the stream starts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.causal import bounded, correlation, decayed_sums, evidence, floored_sd, midrank, normal_quantile, over_history, rolling_sums, series, upto

ORDER = 5  # of the autoregression
RIDGE = 1.0
WINDOWS = (32, 128, 256)
LONG_WINDOWS = (32, 128, 512)
SIGN_WINDOWS = (128, 256)
FEWEST_PAIRS = 8
HAC_LAGS = 16
#: Stream of the conditional scale: share of a new squared innovation, and whether it is clipped.
SCALES = {"s": (0.01, False), "f": (0.05, False), "r": (0.01, True)}


def past() -> Column:
    return F.col("period") == 1


def online() -> Column:
    return F.col("period") == 2


def fit_rows() -> Column:
    """The history's first part."""
    return F.col("k") < F.col("cut")


def ref_rows() -> Column:
    """The history's second part, C."""
    return past() & (F.col("k") >= F.col("cut"))


def _mean(*cols: Column) -> Column:
    return reduce(lambda a, b: a + b, cols) / len(cols)


def solve(df: DataFrame, a: list[list[str]], b: list[str], out: list[str]) -> DataFrame:
    """Adds out: the solution of a symmetric positive system whose entries are columns, by elimination, one step a projection."""
    n = len(b)
    keep = [c for c in df.columns if c not in {x for r in a for x in r} | set(b)]
    m = [[F.col(x) for x in r] + [F.col(y)] for r, y in zip(a, b, strict=True)]
    df = df.select(*keep, *[m[i][j].alias(f"_e{i}_{j}") for i in range(n) for j in range(n + 1)])
    for p in range(n):
        e = lambda i, j: F.col(f"_e{i}_{j}")
        top = [e(p, j) / e(p, p) for j in range(n + 1)]
        cols = [(top[j] if i == p else e(i, j) - e(i, p) * top[j]).alias(f"_e{i}_{j}") for i in range(n) for j in range(p + 1, n + 1)]
        done = [e(i, j) for i in range(n) for j in range(p + 1)]
        df = df.select(*keep, *cols, *[c for c in done if p < n - 1])
    return df.select(*keep, *[F.col(f"_e{i}_{n}").alias(o) for i, o in enumerate(out)])


def lag_sums(df: DataFrame, z: str, rows: Column, order: int) -> list[Column]:
    """Aggregates of the normal equations of z on 1 and its lags (columns l1..), over rows."""
    x = [F.lit(1.0), *[F.col(f"l{j}") for j in range(1, order + 1)]]
    out = []
    for i in range(order + 1):
        for j in range(i, order + 1):
            ridge = RIDGE if i == j and i else 0.0
            out.append((F.sum(F.when(rows, x[i] * x[j])) + ridge).alias(f"a{i}_{j}"))
        out.append(F.sum(F.when(rows, x[i] * F.col(z))).alias(f"y{i}"))
    return out


def autoregression(df: DataFrame, order: int = ORDER, fit: Column | None = None, prefix: str = "beta") -> DataFrame:
    """Adds az (value in the fit rows' units), e (innovation) and the coefficients, from a ridge fit on the fit rows.

    Lags run across the history's end into the stream. Every series needs
    max(32, 4 * order) fit rows that vary; another raises, none is replaced.
    """
    fit = fit_rows() if fit is None else fit
    df = df.withColumns({"ar_mu": over_history(F.avg, fit, F.col("value")), "ar_sd": F.stddev_samp(F.when(fit, F.col("value"))).over(series()), "_nfit": F.count(F.when(fit, 1)).over(series())})
    few = (F.col("_nfit") < max(32, 4 * order)) | F.col("ar_sd").isNull() | (F.col("ar_sd") <= 1e-8)
    df = df.withColumn("ar_sd", F.when(few, F.raise_error(F.concat(F.lit("history too short or constant: "), F.col("id").cast("string"))).cast("double")).otherwise(F.col("ar_sd")))
    df = df.withColumn("az", (F.col("value") - F.col("ar_mu")) / F.col("ar_sd")).drop("_nfit")
    df = df.withColumns({f"l{j}": F.lag("az", j).over(series().orderBy("k")) for j in range(1, order + 1)})
    sums = df.groupBy("id").agg(*lag_sums(df, "az", fit & F.col(f"l{order}").isNotNull(), order))
    name = lambda i, j: f"a{min(i, j)}_{max(i, j)}"
    names = [f"{prefix}{i}" for i in range(order + 1)]
    coefs = solve(sums, [[name(i, j) for j in range(order + 1)] for i in range(order + 1)], [f"y{i}" for i in range(order + 1)], names)
    df = df.join(coefs, "id")
    e = F.col("az") - F.col(names[0])
    for j in range(1, order + 1):
        e = e - F.col(names[j]) * F.col(f"l{j}")
    return df.withColumn("e", e).drop(*[f"l{j}" for j in range(1, order + 1)])


def innovation(df: DataFrame) -> DataFrame:
    """Adds r (innovation in C's units) and mse_ratio."""
    e, z, ref = F.col("e"), F.col("az"), ref_rows()
    df = df.withColumns({"_m": over_history(F.avg, ref, e), "_sd": floored_sd(ref, e), "_e2": over_history(F.avg, ref, e * e), "_z2": over_history(F.avg, ref, z * z)})
    return df.withColumns({"r": (e - F.col("_m")) / F.col("_sd"), "mse_ratio": F.try_divide("_e2", "_z2")}).drop("_m", "_sd", "_e2", "_z2")


def raw_energy(df: DataFrame, name: str, whole_history: bool = False) -> DataFrame:
    """Adds name: squares of the values, standardised by C or by the whole history."""
    ref, v = past() if whole_history else ref_rows(), F.col("value")
    df = df.withColumns({"_m": over_history(F.avg, ref, v), "_sd": floored_sd(ref, v)})
    return df.withColumn(name, F.pow((v - F.col("_m")) / F.col("_sd"), 2)).drop("_m", "_sd")


def centred_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds <name>_v and <name>_w: midrank of value among C, on (-1, 1), and its square."""
    df = midrank(df, value, ref_rows(), "_u")
    v = 2 * F.col("_u") - 1
    return df.withColumns({f"{name}_v": v, f"{name}_w": v * v}).drop("_u")


def scales(df: DataFrame, kinds: list[str]) -> DataFrame:
    """Adds v_<kind> (forecast of the squared innovation), u_<kind> and a_<kind> (innovation over it, and in C's units).

    The scale is a decayed mean of squared innovations, started at the fit rows'
    mean and forecast before it sees the row. The robust one clips squares at
    the fit rows' 99 % quantile and makes up for the loss.
    """
    df = df.withColumn("_e2", F.when(F.col("k") >= ORDER, F.col("e") * F.col("e")))
    fit = fit_rows() & (F.col("k") >= ORDER)
    df = df.withColumn("_b0", F.greatest(over_history(F.avg, fit, F.col("_e2")), F.lit(1e-16)))
    if any(SCALES[k][1] for k in kinds):
        df = df.withColumn("_cap", F.percentile(F.when(fit, F.col("_e2")), F.lit(0.99)).over(series()))
        df = df.withColumn("_clip", over_history(F.avg, fit, F.least("_e2", "_cap")))
    drivers, out = {}, {}
    for k in kinds:
        clipped = F.when(F.col("_e2").isNull(), None).when(F.col("_clip") > 1e-16, F.col("_b0") / F.col("_clip") * F.least("_e2", "_cap")).otherwise(F.col("_e2")) if SCALES[k][1] else F.col("_e2")
        drivers[f"_d{k}"] = clipped
    df = decayed_sums(df.withColumns(drivers), {f"_s{k}": (f"_d{k}", 1 - SCALES[k][0]) for k in kinds}, "k").drop(*drivers)
    before = series().orderBy("k")
    for k in kinds:
        share = SCALES[k][0]
        h = F.pow(F.lit(1 - share), F.col("k") - ORDER) * F.col("_b0") + share * F.coalesce(F.lag(f"_s{k}").over(before), F.lit(0.0))
        out[f"v_{k}"] = F.when(F.col("k") >= ORDER, F.greatest(h, F.lit(1e-16), 1e-4 * F.col("_b0")))
    df = df.withColumns(out).drop("_e2", "_b0", "_cap", "_clip", *[f"_s{k}" for k in kinds])
    df = df.withColumns({f"u_{k}": F.col("e") / F.sqrt(f"v_{k}") for k in kinds})
    ref = ref_rows()
    df = df.withColumns({f"_m{k}": over_history(F.avg, ref, F.col(f"u_{k}")) for k in kinds} | {f"_sd{k}": floored_sd(ref, F.col(f"u_{k}")) for k in kinds})
    df = df.withColumns({f"a_{k}": (F.col(f"u_{k}") - F.col(f"_m{k}")) / F.col(f"_sd{k}") for k in kinds})
    return df.drop(*[f"_{n}{k}" for n in ("m", "sd") for k in kinds])


def normal_scores(df: DataFrame) -> DataFrame:
    """Adds nz: the normal quantile of the slow scale's u among C, with its C mean nz_mu and variance nz_v0."""
    df = midrank(df, "u_s", ref_rows(), "_p")
    df = normal_quantile(df.withColumn("_p", F.when(F.col("u_s").isNotNull(), F.col("_p"))), "_p", "nz").drop("_p")
    df = df.withColumn("nz_mu", over_history(F.avg, ref_rows(), F.col("nz")))
    return df.withColumn("nz_v0", over_history(F.avg, ref_rows(), F.pow(F.col("nz") - F.col("nz_mu"), 2)))


def sign_pairs(df: DataFrame) -> DataFrame:
    """Adds sg_a and sg_b, the signs of an online innovation's predecessor and itself about C's median, and sg_ref, their correlation over C.

    The first online row has no pair.
    """
    ref = ref_rows()
    df = df.withColumn("_med", F.percentile(F.when(ref, F.col("e")), F.lit(0.5)).over(series()))
    df = df.withColumn("_s", F.signum(F.col("e") - F.col("_med")))
    df = df.withColumn("_b", F.lag("_s").over(series().orderBy("k")))
    a, b = (F.when(ref & (F.col("k") > F.col("cut")), F.col(c)) for c in ("_b", "_s"))
    sums = [F.coalesce(F.sum(x).over(series()), F.lit(0.0)) for x in (F.when(a.isNotNull(), 1.0), a, b, a * a, b * b, a * b)]
    df = df.withColumns({f"_c{i}": x for i, x in enumerate(sums)})
    live = online() & (F.col("t") > 0)
    df = df.withColumns({"sg_ref": correlation(*[F.col(f"_c{i}") for i in range(6)]), "sg_a": F.when(live, F.col("_b")), "sg_b": F.when(live, F.col("_s"))})
    return df.drop("_med", "_s", "_b", *[f"_c{i}" for i in range(6)])


MOMENTS = ("m1", "m2", "m3", "m4", "m5")


def hermite_channels(df: DataFrame) -> DataFrame:
    """Adds h_m1..h_m5: four Hermite polynomials of nz and its lag product, each in C's units; null where a pair is missing."""
    z, c = F.col("nz"), F.col("nz") - F.col("nz_mu")
    made = {
        "m1": z, "m2": (z * z - 1) / F.sqrt(F.lit(2.0)), "m3": (z * z * z - 3 * z) / F.sqrt(F.lit(6.0)),
        "m4": (z * z * z * z - 6 * z * z + 3) / F.sqrt(F.lit(24.0)), "m5": c * F.lag(c).over(series().orderBy("k")),
    }
    df = df.withColumns({f"h_{n}": v for n, v in made.items()})
    ref = {n: ref_rows() & (F.col("k") > F.col("cut")) if n == "m5" else ref_rows() for n in made}
    live = {n: online() & (F.col("t") > 0) if n == "m5" else online() for n in made}
    df = df.withColumns({f"_m{n}": over_history(F.avg, ref[n], F.col(f"h_{n}")) for n in made} | {f"_s{n}": floored_sd(ref[n], F.col(f"h_{n}")) for n in made})
    df = df.withColumns({f"h_{n}": F.when(live[n], (F.col(f"h_{n}") - F.col(f"_m{n}")) / F.col(f"_s{n}")) for n in made})
    return df.drop(*[f"_{x}{n}" for x in "ms" for n in made])


def directional(n: Column, mean: Column, v0: Column, eta: Column) -> tuple[Column, Column]:
    """Evidence that a variance went up, and that it went down: the likelihood ratio of mean against v0, over eta."""
    r = F.greatest(mean, F.lit(0.0)) / v0
    d = r - 1
    kernel = F.greatest(F.when(F.abs(d) <= 0.5, d - F.log1p(d)).when(r > 0, d - F.ln(r)), F.lit(0.0))
    value = bounded(n / 2 * kernel / eta)
    ok = (v0 > 1e-16) & (n >= FEWEST_PAIRS)
    up = F.when(ok & (r > 1), value).otherwise(0.0)
    return up, F.when(ok & (r == 0), 1.0).when(ok & (r < 1), value).otherwise(0.0)


def long_run_factor(df: DataFrame) -> DataFrame:
    """Adds hac_eta: how much wider the mean of (nz - nz_mu) ** 2 spreads than for independent normal values, from C.

    Bartlett weights on HAC_LAGS autocovariances; 1 with fewer than 2 * (HAC_LAGS + 1) rows or no variance.
    """
    df = df.withColumn("_q", F.when(ref_rows(), F.pow(F.col("nz") - F.col("nz_mu"), 2) - F.col("nz_v0")))
    q, order = F.col("_q"), series().orderBy("k")
    # the weighted sum of lag products of a row, so that one sum over the series is left
    row = q * q
    for g in range(1, HAC_LAGS + 1):
        row = row + 2 * (1 - g / (HAC_LAGS + 1)) * F.coalesce(q * F.lag("_q", g).over(order), F.lit(0.0))
    df = df.withColumn("_row", row)
    df = df.withColumns({"_m": F.count("_q").over(series()), "_t": F.sum("_row").over(series())})
    v0 = F.col("nz_v0")
    eta = F.greatest(F.lit(1.0), F.try_divide(F.greatest(F.col("_t") / F.col("_m"), F.lit(0.0)), 2 * v0 * v0))
    ok = (F.col("_m") >= 2 * (HAC_LAGS + 1)) & (v0 > 1e-16)
    return df.withColumn("hac_eta", F.when(ok, eta).otherwise(1.0)).drop("_q", "_row", "_m", "_t")


def references(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """Adds <name>_rm and <name>_rs: mean and sd over C of each name's value column."""
    ref = ref_rows()
    cols = {}
    for name, v in values.items():
        cols |= {f"{name}_rm": over_history(F.avg, ref, F.col(v)), f"{name}_rs": floored_sd(ref, F.col(v))}
    return df.withColumns(cols) if cols else df


#: What each family of blocks is called; through names sets of them.
FAMILIES = {"base": ("r", "i", "p", "d"), "scale": ("r", "i", "p", "d", "js", "jf", "jr", "ps"), "normal": ("r", "i", "p", "d", "js", "jf", "jr", "ps", "m", "l")}


def features(df: DataFrame, through: str = "normal", only: tuple[str, ...] | None = None) -> DataFrame:
    """Online rows with evidence blocks: r (or rh, by the whole history), i, p, d, js, jf, jr, ps, m, l.

    Everything that needs the history is worked out first; then references are
    frozen, the history is dropped, and the stream goes through one window of
    running sums and one of their lags, which give all rolling means at once.
    """
    want = set(only or FAMILIES[through])
    ready = "nz" in df.columns  # normal scores are there already: only m and l may be wanted
    if ready and want - {"m", "l"}:
        raise ValueError("a frame with normal scores gives the blocks m and l alone")
    keep = [c for c in df.columns if c not in ("cut", "period", "H", "n", "nz", "nz_mu", "nz_v0")]
    values: dict[str, str] = {}
    extra: list[str] = []
    if "r" in want or "rh" in want:
        df = raw_energy(df, "_raw2", "rh" in want)
        values["blk_r"] = "_raw2"
    if want - {"r", "rh"} and not ready:
        df = autoregression(df).drop("ar_mu", "ar_sd", *[f"beta{i}" for i in range(ORDER + 1)])
        df = innovation(df).drop("az")
        extra += ["e", "r", "mse_ratio"]
    if "i" in want:
        df = df.withColumn("_inn2", F.col("r") * F.col("r"))
        values["blk_i"] = "_inn2"
    if "p" in want:
        df = centred_ranks(df, "r", "_p")
        values |= {"blk_p_location": "_p_v", "blk_p_energy": "_p_w"}
    if "d" in want:
        df = sign_pairs(df)
    kinds = [k for k in SCALES if f"j{k}" in want or (k == "s" and want & {"ps", "m", "l"})]
    if kinds and not ready:
        df = scales(df, kinds)
        extra += [f"{c}_{k}" for k in kinds for c in "vua"]
        for k in kinds:
            if f"j{k}" in want:
                df = df.withColumn(f"_v{k}", F.pow(f"a_{k}", 2))
                values[f"blk_j{k}"] = f"_v{k}"
    if "ps" in want:
        df = centred_ranks(df, "a_s", "_ps")
        values |= {"blk_ps_location": "_ps_v", "blk_ps_energy": "_ps_w"}
    if want & {"m", "l"}:
        df = df if ready else normal_scores(df)
        extra.append("nz")
    if "m" in want:
        df = hermite_channels(df)
    if "l" in want:
        df = long_run_factor(df)
        df = df.withColumn("_l", F.pow(F.col("nz") - F.col("nz_mu"), 2))
        extra += ["nz_v0", "hac_eta"]
    whole = "rh" in want and len(values) == 1
    if whole:
        df = df.withColumn("cut", F.lit(0))  # the whole history is the reference
    df = references(df, values).filter("period = 2")

    rolling: dict[str, tuple[str, tuple[int, ...], Column]] = {n: (v, WINDOWS, F.col("t") + 1) for n, v in values.items()}
    if "m" in want:
        rolling |= {m: (f"h_{m}", tuple(w - 1 for w in LONG_WINDOWS) if m == "m5" else LONG_WINDOWS, F.col("t") + (0 if m == "m5" else 1)) for m in MOMENTS}
    if "l" in want:
        rolling["l"] = ("_l", LONG_WINDOWS, F.col("t") + 1)
    if "d" in want:
        a, b = F.col("sg_a"), F.col("sg_b")
        df = df.withColumns({f"_g{i}": x for i, x in enumerate((a, b, a * a, b * b, a * b))})
        rolling |= {f"g{i}": (f"_g{i}", tuple(w - 1 for w in SIGN_WINDOWS), F.col("t")) for i in range(5)}
    df, mean = rolling_sums(df, rolling)

    out: dict[str, Column] = {}
    for n in values:
        parts = [evidence(c, F.try_divide(s, c), f"{n}_rm", f"{n}_rs") for s, c in mean[n]]
        out |= {f"{n}{i + 1}": p for i, p in enumerate(parts)}
    if "m" in want:
        for m in MOMENTS:
            few = FEWEST_PAIRS if m == "m5" else 1
            parts = [F.when(c >= few, bounded(F.sqrt(c) * F.abs(F.try_divide(s, c)))).otherwise(0.0) for s, c in mean[m]]
            out[m] = (F.greatest(*parts[:3]) + parts[3]) / 2
    if "l" in want:
        for n, eta in (("l", F.lit(1.0)), ("c", F.col("hac_eta"))):
            both = [directional(c, F.try_divide(s, c), F.col("nz_v0"), eta) for s, c in mean["l"]]
            for i, side in enumerate(("plus", "minus")):
                parts = [x[i] for x in both]
                out[f"{n}_{side}"] = (F.greatest(*parts[:3]) + parts[3]) / 2
    if "d" in want:
        for j, w in enumerate(SIGN_WINDOWS):
            m = mean["g0"][j][1]
            rho = correlation(m.cast("double"), *[F.coalesce(mean[f"g{i}"][j][0], F.lit(0.0)) for i in range(5)])
            ok = (m >= FEWEST_PAIRS) & rho.isNotNull() & F.col("sg_ref").isNotNull()
            out[f"blk_d{w}"] = F.when(ok, bounded(F.sqrt(m) * F.abs(rho - F.col("sg_ref")))).otherwise(0.0)
    df = df.select(*keep, *extra, *[c.alias(n) for n, c in out.items()])
    means = {n: _mean(*[F.col(f"{n}{i}") for i in range(1, 5)]) for n in values}
    df = df.withColumns(means) if means else df
    late: dict[str, Column] = {}
    if "p" in want:
        late["blk_p"] = _mean(F.col("blk_p_location"), F.col("blk_p_energy"))
    if "ps" in want:
        late["blk_ps"] = _mean(F.col("blk_ps_location"), F.col("blk_ps_energy"))
    if "d" in want:
        late["blk_d"] = _mean(*[F.col(f"blk_d{w}") for w in SIGN_WINDOWS])
    df = df.withColumns(late) if late else df
    if "i" in want:
        root = F.sqrt(F.lit(2.0))
        apart = {f"c_{k}": (F.col(f"blk_j{k}") - F.col("blk_i")) / root for k in kinds if f"j{k}" in want}
        if {"p", "ps"} <= want:
            apart["k_s"] = (F.col("blk_ps") - F.col("blk_p")) / root
        df = df.withColumns(apart) if apart else df
    if "l" in want:
        df = df.withColumn("_cur", F.greatest("l_plus", "l_minus"))
        df = df.withColumn("drawdown", F.greatest(F.lit(0.0), F.max("_cur").over(upto())) - F.col("_cur"))
        df = decayed_sums(df, {"_tr": ("_cur", 0.99)}, "t").withColumn("trajectory_ewma", 0.01 * F.col("_tr")).drop("_cur", "_tr")
    return df


def historical_null(df: DataFrame) -> DataFrame:
    """The blocks m and l of C itself, from the start: C's normal scores as if they were the stream, against references from the same C."""
    d = normal_scores(scales(innovation(autoregression(df)), ["s"])).select("id", "k", "H", "cut", "period", "t", "nz", "nz_mu", "nz_v0")
    c = d.filter(ref_rows()).withColumns({"t": F.col("k") - F.col("cut"), "period": F.lit(2)}).withColumn("k", F.col("H") + F.col("t"))
    return features(d.filter(past()).unionByName(c), only=("m", "l"))


#: Blocks whose mean is an experiment's score.
EXPERIMENTS = {
    "E02": ("rh",), "E03": ("r",), "E04": ("i",), "E05": ("r", "i"), "E06": ("r", "i", "p"), "E07": ("r", "i", "p", "d"),
}


def experiment(df: DataFrame, name: str) -> DataFrame:
    """Online rows with prediction, the mean of the experiment's blocks."""
    used = EXPERIMENTS[name]
    return features(df, only=used).withColumn("prediction", _mean(*[F.col(f"blk_{b[0] if b == 'rh' else b}") for b in used]))
