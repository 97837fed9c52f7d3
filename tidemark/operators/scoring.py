"""Pair-weighted scores by online age, and what is derived from them.

A score frame has id, t, target and one or more prediction columns. The AUC of
an age is its Mann-Whitney statistic with ties half; ages weigh by the product
of their positives and negatives, so the total is one ratio of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Ranges of scores that an age is cut into.
RANGES = 256
#: First and last age (from 1) of each bucket.
BUCKETS = ((1, 8), (9, 16), (17, 32), (33, 64), (65, 128), (129, 256), (257, 512), (513, None))


def violations(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """One row of counts, all 0 for a valid frame: null or repeated keys, ages, labels, predictions."""
    p = F.col(prediction)
    finite = p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    rows = df.agg(
        F.count(F.when(F.col("id").isNull() | F.col("t").isNull(), 1)).alias("null_keys"),
        F.count(F.when((F.col("t") < 0) | (F.col("t") != F.floor("t")), 1)).alias("bad_ages"),
        F.count(F.when(F.col("target").isNull() | ~F.col("target").isin(0, 1), 1)).alias("bad_targets"),
        F.count(F.when(~finite, 1)).alias("nonfinite"),
        F.count(F.when(finite & ((p < 0) | (p > 1)), 1)).alias("outside_unit"),
    )
    twice = df.groupBy("id", "t").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").agg(F.count(F.lit(1)).alias("duplicate_keys"))
    return rows.crossJoin(twice)  # one row by one row


def score_range(p: Column) -> Column:
    """Which of RANGES a score falls in, in the scores' order; what is outside [0, 1] is in the first or last."""
    return F.greatest(F.lit(0), F.least(F.lit(RANGES - 1), F.floor(p * RANGES))).cast("int")


def pair_terms(df: DataFrame, prediction: str = "prediction", by: tuple[str, ...] = ()) -> DataFrame:
    """For each age (and by): active, positive, negative, weight, u (the Mann-Whitney statistic).

    Rows are counted by score; a window orders the scores of one age and range, and
    another the ranges of an age, so that no task holds an age's scores whole.
    """
    keys = [*by, "t"]
    ties = df.groupBy(*keys, F.col(prediction).alias("_p")).agg(F.sum("target").alias("pos"), F.count(F.lit(1)).alias("rows"))
    return _summed(_ranged(ties.withColumn("_r", score_range(F.col("_p"))), keys), keys)


def _ranged(ties: DataFrame, keys: list[str]) -> DataFrame:
    """Scores counted in pos and rows to one row an age and range, with the pairs inside it."""
    ties = ties.withColumn("neg", F.col("rows") - F.col("pos"))
    below = F.coalesce(F.sum("neg").over(W.partitionBy(*keys, "_r").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ties = ties.withColumn("u", F.col("pos") * (below + F.col("neg") / 2))
    return ties.groupBy(*keys, "_r").agg(F.sum("rows").alias("rows"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("u").alias("u"))


def _summed(r: DataFrame, keys: list[str]) -> DataFrame:
    """Ages from their ranges."""
    under = F.coalesce(F.sum("neg").over(W.partitionBy(*keys).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    r = r.withColumn("u", F.col("u") + F.col("pos") * under)
    g = r.groupBy(*keys).agg(F.sum("rows").alias("active"), F.sum("pos").alias("positive"), F.sum("neg").alias("negative"), F.sum("u").alias("u"))
    return g.withColumn("weight", F.col("positive") * F.col("negative"))


def per_age(df: DataFrame, prediction: str = "prediction", by: tuple[str, ...] = ()) -> DataFrame:
    """pair_terms with age, auc (null for one class only) and weight_fraction."""
    g = pair_terms(df, prediction, by)
    total = g.groupBy(*by).agg(F.sum("weight").alias("_w")) if by else g.agg(F.sum("weight").alias("_w"))
    g = g.join(total, list(by)) if by else g.crossJoin(F.broadcast(total))  # one row
    return g.select(
        *by, "t", (F.col("t") + 1).alias("age"), "active", "positive", "negative", "weight",
        F.try_divide("u", "weight").alias("auc"), F.coalesce(F.try_divide("weight", "_w"), F.lit(0.0)).alias("weight_fraction"), "u",
    )


def total(terms: DataFrame, *by: str) -> DataFrame:
    """Score of pair terms: 0.5 where no pair counts."""
    aggs = (F.sum("u").alias("u"), F.sum("weight").alias("pair_weight"), F.count(F.when(F.col("weight") > 0, 1)).alias("eligible_ages"))
    g = terms.groupBy(*by).agg(*aggs) if by else terms.agg(*aggs)
    return g.select(*by, F.coalesce(F.try_divide(F.coalesce("u", F.lit(0.0)), "pair_weight"), F.lit(0.5)).alias("ts_auc"), F.coalesce("pair_weight", F.lit(0)).alias("pair_weight"), "eligible_ages")


def ts_auc(df: DataFrame, prediction: str = "prediction", by: tuple[str, ...] = ()) -> DataFrame:
    return total(pair_terms(df, prediction, by), *by)


def expected(df: DataFrame, keys: DataFrame, prediction: str = "prediction") -> DataFrame:
    """df, if it is a valid frame over exactly these keys (id, t); otherwise an error that says what is wrong."""
    found = violations(df, prediction).first().asDict()
    found["missing"] = keys.join(df, ["id", "t"], "left_anti").count()
    found["unexpected"] = df.join(keys, ["id", "t"], "left_anti").count()
    if wrong := {k: v for k, v in found.items() if v}:
        raise ValueError(f"not a valid score frame: {wrong}")
    return df


def age_bucket() -> Column:
    out = None
    for lo, hi in BUCKETS:
        cond = (F.col("t") + 1 >= lo) & (F.col("t") + 1 <= hi) if hi else F.col("t") + 1 >= lo
        name = f"{lo}-{hi}" if hi else f"{lo}+"
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def buckets(terms: DataFrame) -> DataFrame:
    """Scores by age bucket; the score is null where no pair counts, and buckets without rows are not listed."""
    g = terms.withColumn("age_range", age_bucket()).groupBy("age_range").agg(
        F.sum("weight").alias("pair_weight"), F.sum("u").alias("u"), F.count(F.when(F.col("weight") > 0, 1)).alias("eligible_ages"),
        F.sum("positive").alias("positive_rows"), F.sum("negative").alias("negative_rows"),
    )
    share = F.coalesce(F.try_divide("pair_weight", F.sum("pair_weight").over(W.partitionBy())), F.lit(0.0))  # eight rows
    return g.select("age_range", "pair_weight", share.alias("weight_fraction"), F.try_divide("u", "pair_weight").alias("ts_auc"), "eligible_ages", "positive_rows", "negative_rows")


def combined(terms: DataFrame) -> DataFrame:
    """Scores over ages up to 64, from 129 and from 257; a set without rows is not listed."""
    sets = {"le64": F.col("t") + 1 <= 64, "ge129": F.col("t") + 1 >= 129, "ge257": F.col("t") + 1 >= 257}
    which = F.explode(F.filter(F.array(*[F.when(c, k) for k, c in sets.items()]), lambda x: x.isNotNull())).alias("ages")
    g = terms.select("*", which).groupBy("ages").agg(
        F.sum("weight").alias("pair_weight"), F.sum("u").alias("u"), F.count(F.when(F.col("weight") > 0, 1)).alias("eligible_ages"),
        F.sum("positive").alias("positive_rows"), F.sum("negative").alias("negative_rows"),
    )
    return g.select("ages", F.try_divide("u", "pair_weight").alias("ts_auc"), "pair_weight", "eligible_ages", "positive_rows", "negative_rows")


def pooled_and_folds(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """The score over all rows (fold -1) and by fold."""
    return total(fold_terms(df, prediction), "fold")


def fold_terms(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """pair_terms over all rows (fold -1) and by fold. Rows are dealt once, by age and range; both are counted from there."""
    p = F.col(prediction)
    x = df.select("t", "target", "fold", p.alias("_p"), score_range(p).alias("_r")).repartition("t", "_r")
    own = x.groupBy("t", "_r", "fold", "_p").agg(F.sum("target").alias("pos"), F.count(F.lit(1)).alias("rows"))
    every = own.groupBy("t", "_r", "_p").agg(F.sum("pos").alias("pos"), F.sum("rows").alias("rows"))
    r = _ranged(own, ["fold", "t"]).unionByName(_ranged(every, ["t"]).withColumn("fold", F.lit(-1)))
    return _summed(r, ["fold", "t"])


def difference(candidate: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """delta of two result frames' ts_auc; null if either is."""
    return candidate.select(key, F.col("ts_auc").alias("candidate")).join(reference.select(key, F.col("ts_auc").alias("reference")), key, "full").withColumn("delta", F.col("candidate") - F.col("reference"))


def training_weights(df: DataFrame) -> DataFrame:
    """df's rows of ages with both classes, with omega: half of an age's weight on each class, all summing to 1."""
    w = df.groupBy("t").agg(F.sum("target").alias("_p"), F.count(F.lit(1)).alias("_n"))
    w = w.withColumn("_n", F.col("_n") - F.col("_p")).withColumn("_w", F.col("_p") * F.col("_n")).filter("_w > 0")
    z = w.agg(F.sum("_w").alias("_z"))
    x = df.join(w, "t").crossJoin(F.broadcast(z))  # one row
    return x.withColumn("omega", F.col("_w") / (2 * F.col("_z") * F.when(F.col("target") == 1, F.col("_p")).otherwise(F.col("_n")))).drop("_p", "_n", "_w", "_z")


def weight_audit(df: DataFrame) -> DataFrame:
    """By age: rows, mass and the mass of each class of training weights, with what they should be."""
    x = training_weights(df).groupBy("t").agg(
        F.sum("target").alias("n_pos"), (F.count(F.lit(1)) - F.sum("target")).alias("n_neg"), F.sum("omega").alias("mass"),
        F.sum(F.when(F.col("target") == 1, F.col("omega"))).alias("positive_mass"), F.sum(F.when(F.col("target") == 0, F.col("omega"))).alias("negative_mass"),
    )
    pairs = F.col("n_pos") * F.col("n_neg")
    z = x.agg(F.sum(pairs).alias("z"))
    return x.crossJoin(F.broadcast(z)).select("t", "n_pos", "n_neg", pairs.alias("pair_weight"), (pairs / F.col("z")).alias("expected_mass"), "mass", "positive_mass", "negative_mass")


def weighted_moments(df: DataFrame, columns: list[str], weight: str = "omega") -> DataFrame:
    """column, mean, std (population) under weights; a constant column has its value and exactly 0."""
    long = df.select(weight, F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("column", "x"))
    w, x = F.col(weight), F.col("x")
    first = long.groupBy("column").agg((F.sum(w * x) / F.sum(w)).alias("m"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    mean = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("m"))
    second = long.join(F.broadcast(first.select("column", mean.alias("mean"))), "column")  # one row a column
    return second.groupBy("column").agg(F.first("mean").alias("mean"), F.sqrt(F.sum(w * F.pow(x - F.col("mean"), 2)) / F.sum(w)).alias("std"))


def ties(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Unordered pairs of one age that share a prediction, of all pairs of one age; and pairs of both classes that tie."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2).cast("long")
    g = df.groupBy("t", prediction).agg(F.count(F.lit(1)).alias("c"), F.sum("target").alias("_pos"))
    tied = g.agg(pairs("c").alias("tied_pairs"), F.sum(F.col("_pos") * (F.col("c") - F.col("_pos"))).cast("long").alias("class_ties"))
    every = g.groupBy("t").agg(F.sum("c").alias("n")).agg(pairs("n").alias("all_pairs"))
    return tied.crossJoin(every).select("tied_pairs", "class_ties", "all_pairs", F.try_divide("tied_pairs", "all_pairs").alias("rate"))


def stuck(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Scores equal to the one before, and scores of exactly 1, over all series."""
    same = F.col(prediction) == F.lag(prediction).over(W.partitionBy("id").orderBy("t"))
    return df.select(same.alias("s"), (F.col(prediction) == 1).alias("one")).agg(
        F.sum(F.coalesce(F.col("s").cast("int"), F.lit(0))).alias("adjacent_ties"), F.sum(F.col("one").cast("int")).alias("saturated"), F.count(F.lit(1)).alias("rows")
    )


def saturation(df: DataFrame, columns: list[str]) -> DataFrame:
    """By column: share at 0, at 1, and at 0.99 or above."""
    long = df.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("column", "x"))
    share = lambda c: F.avg(c.cast("double"))
    return long.groupBy("column").agg(share(F.col("x") == 0).alias("at_zero"), share(F.col("x") == 1).alias("at_one"), share(F.col("x") >= 0.99).alias("ge_099"))


def correlations(df: DataFrame, columns: list[str], against: list[str]) -> DataFrame:
    """Weighted correlations of column pairs, plain and about the mean of each age; near marks |r| of 0.98 or more.

    A row weighs its age's pair weight over the age's rows. All pairs come from one pass of sums.
    """
    n = df.groupBy("t").agg(F.count(F.lit(1)).alias("_n"), F.sum("target").alias("_p"), *[F.avg(c).alias(f"_m_{c}") for c in dict.fromkeys(columns + against)])
    n = n.withColumn("_w", F.col("_p") * (F.col("_n") - F.col("_p")))
    z = n.agg(F.sum("_w").alias("_z"))
    x = df.join(n, "t").crossJoin(F.broadcast(z)).withColumn("_rw", F.col("_w") / F.col("_z") / F.col("_n"))
    pairs = [(c, a) for c in columns for a in against]
    vec = lambda kind, c: F.col(c) if kind == "raw" else F.col(c) - F.col(f"_m_{c}")
    means = x.agg(*[F.sum(F.col("_rw") * vec(k, c)).alias(f"_g_{k}_{c}") for k in ("raw", "age") for c in dict.fromkeys(columns + against)])
    x = x.crossJoin(F.broadcast(means))
    d = lambda k, c: vec(k, c) - F.col(f"_g_{k}_{c}")
    sums = {}
    for k in ("raw", "age"):
        for c in dict.fromkeys(columns + against):
            sums[f"v_{k}_{c}"] = F.sum(F.col("_rw") * d(k, c) * d(k, c))
        for c, a in pairs:
            sums[f"x_{k}_{c}_{a}"] = F.sum(F.col("_rw") * d(k, c) * d(k, a))
    one = x.agg(*[v.alias(k) for k, v in sums.items()])

    def r(k, c, a):
        vx, vy = F.col(f"v_{k}_{c}"), F.col(f"v_{k}_{a}")
        return F.when((vx > 0) & (vy > 0), F.col(f"x_{k}_{c}_{a}") / F.sqrt(vx * vy))

    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(a).alias("against"), r("raw", c, a).alias("raw_weighted"), r("age", c, a).alias("age_centered")) for c, a in pairs])).alias("r")
    return one.select(rows).select("r.*").withColumn("near", F.coalesce(F.abs("age_centered") >= 0.98, F.lit(False)))


def milestones(terms: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """share, age: the first age by which the cumulative weight reaches each share. One row an age goes through one window."""
    c = terms.select("t", (F.sum("weight").over(W.orderBy("t").rowsBetween(W.unboundedPreceding, 0)) / F.sum("weight").over(W.partitionBy())).alias("c"))
    which = F.explode(F.array(*[F.lit(s) for s in shares])).alias("share")
    return c.select("t", "c", which).filter(F.col("c") >= F.col("share")).groupBy("share").agg((F.min("t") + 1).alias("age"))


def absorption(df: DataFrame, kinds: tuple[str, ...] = ("s", "f", "r")) -> DataFrame:
    """How fast a scale takes up a break: by kind and time since, quartiles over series of mean ratios.

    Needs id, t, tau_index, e2 and v_<kind>; a series counts where it has rows, its first scale after the break is the base.
    """
    d = df.filter("tau_index >= 0 and t >= tau_index").withColumn("since", F.col("t") - F.col("tau_index") + 1)
    bin_ = F.when(F.col("since") <= 32, "1-32").when(F.col("since") <= 128, "33-128").when(F.col("since") <= 256, "129-256").otherwise("257+")
    order = W.partitionBy("id").orderBy("t")
    for k in kinds:
        d = d.withColumn(f"base_{k}", F.first(f"v_{k}").over(order))
    long = d.select("id", bin_.alias("bin"), "e2", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"v_{k}").alias("v"), F.col(f"base_{k}").alias("base")) for k in kinds])).alias("x")).select("id", "bin", "e2", "x.*")
    one = long.groupBy("kind", "bin", "id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("e2") / F.col("base")).alias("energy_over_break"), F.avg(F.col("e2") / F.col("v")).alias("energy_over_predictive"), F.avg(F.col("v") / F.col("base")).alias("predictive_over_break"))
    names = ("energy_over_break", "energy_over_predictive", "predictive_over_break")
    quart = [F.percentile(c, F.lit(q)).alias(f"{c}_{n}") for c in names for q, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))]
    return one.groupBy("kind", "bin").agg(F.count(F.lit(1)).alias("series"), F.sum("n").alias("observations"), *quart)
