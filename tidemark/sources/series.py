"""Where series come from: the long form, and adapters from other tables.

The long form has one row per observation: id, ordinal (the order within the
series, which time never changes), value, period (1 history, 2 online), and for
online rows t (place in the stream, from 0) and target. Every series also
carries H (history length) and cut (where the history's second part, C, starts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Share of a history that fits models; the rest gives references. Binary double arithmetic, as 0.7 * n rounds.
FIT_SHARE = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_number(spark: SparkSession, path: str, name: str = "ordinal") -> DataFrame:
    """A parquet scan with each row's physical place: file, then row in the file."""
    df = spark.read.parquet(path)
    if name in df.columns or "file_row_number" in df.columns:
        raise ValueError("reserved column present")
    return df.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.row_index").alias(name))


def require_columns(df: DataFrame, names: set[str]) -> None:
    missing = names - set(df.schema.fieldNames())
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")


def _positions(df: DataFrame) -> DataFrame:
    """Adds cut and t to rows that have k, H, period."""
    online = F.col("period") == 2
    return df.withColumn("cut", F.floor(F.lit(FIT_SHARE) * F.col("H")).cast("int")).withColumn("t", F.when(online, F.col("k") - F.col("H")).cast("int"))


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of a supplier's line items in shipping order; the first 60 % are history, labels are a rule on the id."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("value"))
    s = W.partitionBy("id")
    k = F.row_number().over(s.orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")) - 1
    d = li.select("id", k.alias("k"), "value", F.count(F.lit(1)).over(s).alias("n"))
    d = d.withColumn("H", F.floor(F.col("n") * F.lit(0.6)).cast("int"))
    d = d.withColumn("period", F.when(F.col("k") < F.col("H"), 1).otherwise(2))
    tau = F.when(F.col("id") % 2 == 0, -1).otherwise((F.col("id") * 37) % 200).cast("int")
    d = _positions(d).withColumn("tau_index", tau)
    hit = (F.col("tau_index") >= 0) & (F.col("t") >= F.col("tau_index"))
    return d.withColumn("target", F.when(F.col("period") == 2, hit.cast("int"))).select("id", "k", "value", "n", "H", "cut", "period", "t", "tau_index", "target")


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values of a user in time order; short series, for the simple detectors and for streams."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    s = W.partitionBy("id")
    d = e.select("id", "ts", "value", (F.row_number().over(s.orderBy("ts", "event_id")) - 1).alias("k"), F.count(F.lit(1)).over(s).alias("n"))
    d = d.withColumn("H", F.floor(F.col("n") * F.lit(0.6)).cast("int")).withColumn("period", F.when(F.col("k") < F.col("H"), 1).otherwise(2))
    return _positions(d)


def from_long(observations: DataFrame, labels: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """The long form from observations (id, time, value, period, ordinal), labels (id, time, target) and index (id, tau_index)."""
    require_columns(observations, {"id", "time", "value", "period", "ordinal"})
    d = observations.select(F.col("id").cast("string").alias("id"), "time", F.col("value").cast("double").alias("value"), F.col("period").cast("int").alias("period"), "ordinal")
    if labels is not None:
        d = d.join(labels.select(F.col("id").cast("string").alias("id"), "time", F.col("target").cast("int").alias("target")), ["id", "time"], "left")
    s = W.partitionBy("id")
    d = d.withColumn("k", F.row_number().over(s.orderBy("period", "ordinal")) - 1).withColumn("n", F.count(F.lit(1)).over(s))
    d = d.withColumn("H", F.coalesce(F.sum(F.when(F.col("period") == 1, 1)).over(s), F.lit(0)).cast("int"))
    d = _positions(d)
    if index is not None:
        d = d.join(index.select(F.col("id").cast("string").alias("id"), F.col("tau_index").cast("int").alias("tau_index")), "id", "left")
    return d


def out_of_order(df: DataFrame) -> DataFrame:
    """id, backward: how often time falls from one row to the next in physical order."""
    back = F.col("time") < F.lag("time").over(W.partitionBy("id").orderBy("ordinal"))
    return df.select("id", back.alias("b")).groupBy("id").agg(F.sum(F.coalesce(F.col("b").cast("int"), F.lit(0))).alias("backward"))


def read_groups(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """A CSV of id, group as text; each id once, all ids covered and no others."""
    g = spark.read.csv(path, header=True, schema="id string, `group` string")
    bad = g.filter("id is null or `group` is null").count() + g.groupBy("id").count().filter("count > 1").count()
    known = ids.select(F.col("id").cast("string").alias("id")).distinct()
    bad += known.join(g, "id", "left_anti").count() + g.join(known, "id", "left_anti").count()
    if bad:
        raise ValueError("the group file must hold every id exactly once")
    return g


def synthetic(spark: SparkSession, series: int = 30, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observations, labels and index of small seeded series for tests and demonstrations.

    Of every three series one has no break, one a step of its level and one a wider
    spread. Each sixth repeats the history of the one before. Series start one after
    another and then run side by side in the table; labels are in no order.
    """
    import numpy as np
    import pandas as pd

    random = np.random.default_rng(seed)
    plan = pd.DataFrame({"id": [f"series-{k}" for k in range(series)], "kind": np.resize(["none", "level", "spread"], series)})
    plan["past"], plan["live"] = random.integers(80, 150, series), random.integers(20, 60, series)
    plan["tau_index"] = np.where(plan["kind"] == "none", -1, (random.random(series) * plan["live"]).astype(int))
    frames, past = [], np.empty(0)
    for row in plan.itertuples():
        past = past if row.Index % 6 == 5 else random.standard_normal(row.past)
        live, after = random.standard_normal(row.live), np.arange(row.live) >= row.tau_index
        if row.kind == "level":
            live += 1.5 * after
        elif row.kind == "spread":
            live *= 1 + 1.5 * after
        n = len(past) + row.live
        frames.append(pd.DataFrame({"id": row.id, "time": np.arange(n), "value": np.concatenate((past, live)), "period": 1 + (np.arange(n) >= len(past)), "start": 5 * row.Index, "target": np.concatenate((np.zeros(len(past), int), after * (row.kind != "none")))}))
    x = pd.concat(frames)
    x = x.assign(at=x["start"] + x["time"]).sort_values(["at", "id"], kind="stable").reset_index(drop=True)
    y = x.loc[x["period"] == 2, ["id", "time", "target"]].sample(frac=1, random_state=seed)
    x["ordinal"] = x.index
    index = plan[["id", "tau_index"]].assign(tau=plan["tau_index"])
    return tuple(spark.createDataFrame(t) for t in (x[["id", "time", "value", "period", "ordinal"]], y, index))
