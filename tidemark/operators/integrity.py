"""Checks of long-form tables, and exact comparison of two result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


#: Codes of the checks: what is wrong, in which table.
CHECKS = (
    "twice_x", "twice_y", "twice_index", "bad_x", "bad_y", "bad_index", "y_without_x", "x_without_y", "x_without_index", "index_without_x",
)


def checks(x: DataFrame, y: DataFrame, index: DataFrame) -> DataFrame:
    """check, failures: how many keys repeat, rows are bad, and rows miss their partner; all 0 for sound data.

    Each table is counted by key once; the counts meet in two full joins.
    """
    tau = F.col("tau_index").cast("double")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    bad_x = F.col("id").isNull() | F.col("time").isNull() | F.col("period").isNull() | ~F.col("period").isin(1, 2)
    bad_y = F.col("id").isNull() | F.col("time").isNull() | F.col("target").isNull() | ~F.col("target").isin(0, 1)
    bad_index = F.col("id").isNull() | F.col("tau_index").isNull() | (tau < -1) | (tau != F.floor(tau))
    a = x.groupBy("id", "time").agg(F.count(F.lit(1)).alias("x"), n(bad_x).alias("bad_x"), n(F.col("period") == 2).alias("online"))
    b = y.groupBy("id", "time").agg(F.count(F.lit(1)).alias("y"), n(bad_y).alias("bad_y"))
    rows = a.join(b, ["id", "time"], "full")
    one = rows.agg(
        n(F.col("x") > 1).alias("twice_x"), n(F.col("y") > 1).alias("twice_y"), F.sum("bad_x").alias("bad_x"), F.sum("bad_y").alias("bad_y"),
        F.sum(F.when(F.col("x").isNull(), F.col("y"))).alias("y_without_x"), F.sum(F.when(F.col("y").isNull(), F.col("online"))).alias("x_without_y"),
    )
    c = x.groupBy("id").agg(F.count(F.lit(1)).alias("x"))
    d = index.groupBy("id").agg(F.count(F.lit(1)).alias("i"), n(bad_index).alias("bad_index"))
    two = c.join(d, "id", "full").agg(
        n(F.col("i") > 1).alias("twice_index"), F.sum("bad_index").alias("bad_index"),
        F.sum(F.when(F.col("i").isNull(), F.col("x"))).alias("x_without_index"), F.sum(F.when(F.col("x").isNull(), F.col("i"))).alias("index_without_x"),
    )
    both = one.crossJoin(two)  # one row by one row
    return both.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(k, F.lit(0)).cast("long").alias("failures")) for k in CHECKS])).alias("c")).select("c.*")


def require_sound(x: DataFrame, y: DataFrame, index: DataFrame) -> None:
    bad = {r["check"]: r["failures"] for r in checks(x, y, index).collect() if r["failures"]}
    if bad:
        raise ValueError(f"integrity checks failed: {bad}")


def differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def difference(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of a full join whose values are not the same (nulls equal), with side: left, right or both."""
    a = left.select(*keys, *[F.col(v).alias(f"{v}_left") for v in values], F.lit(1).alias("_l"))
    b = right.select(*keys, *[F.col(v).alias(f"{v}_right") for v in values], F.lit(1).alias("_r"))
    j = a.join(b, keys, "full")
    apart = reduce(lambda p, q: p | q, [differs(F.col(f"{v}_left"), F.col(f"{v}_right")) for v in values])
    side = F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right").otherwise("both")
    return j.withColumn("side", side).filter(apart | (F.col("side") != "both")).drop("_l", "_r")


def coverage(predictions: DataFrame, expected: DataFrame, manifest: DataFrame) -> DataFrame:
    """Counts of what is wrong with predictions (id, t, target, fold, prediction) against the online rows and folds."""
    e = expected.select("id", "t", F.col("target").alias("_target"), F.lit(1).alias("_e"))
    m = manifest.select("id", F.col("fold").alias("_fold"))
    j = predictions.join(e, ["id", "t"], "full").join(m, "id", "left")
    p = F.col("prediction")
    finite = p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    n = lambda c: F.count(F.when(c, 1))
    here = F.col("target").isNotNull()
    return j.agg(
        F.count(F.lit(1)).alias("rows"), n(F.col("_e").isNull()).alias("unexpected"), n(~here).alias("missing"),
        n(here & differs(F.col("target"), F.col("_target"))).alias("wrong_target"), n(here & differs(F.col("fold"), F.col("_fold"))).alias("wrong_fold"),
        n(here & (~finite | (p < 0) | (p > 1))).alias("bad_prediction"),
    )


def label_alignment(df: DataFrame) -> DataFrame:
    """By series: first positive place, whether labels fall again, and whether they are tau_index shifted by -1, 0 or 1."""
    o = df.filter("period = 2").select("id", "t", "target", "tau_index")
    from ..functions.causal import series

    o = o.withColumn("falls", F.coalesce((F.lag("target").over(series().orderBy("t")) > F.col("target")).cast("int"), F.lit(0)))
    match = [F.min((F.col("target") == ((F.col("tau_index") >= 0) & (F.col("t") >= F.col("tau_index") + s)).cast("int")).cast("int")).alias(f"match_{n}") for s, n in ((-1, "before"), (0, "same"), (1, "after"))]
    g = o.groupBy("id", "tau_index").agg(F.max("falls").alias("falls"), F.min(F.when(F.col("target") == 1, F.col("t"))).alias("first_positive"), F.count(F.lit(1)).alias("online"), *match)
    third = F.floor(3 * F.col("first_positive") / F.col("online"))
    age = F.col("first_positive") + 1
    return g.withColumn("offset", F.when(F.col("tau_index") >= 0, F.col("first_positive") - F.col("tau_index"))).withColumn(
        "phase", F.when(3 * age <= F.col("online"), "early").when(3 * age <= 2 * F.col("online"), "middle").when(third.isNotNull(), "late")
    )
