"""Strata, folds, partitions, bootstrap, and the rules that choose between experiments."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.artifacts import shared_dir
from .scoring import RANGES, score_range

FOLDS = 5
RANGE_SERIES = 4096
STRATA = ("no_break", "break_1_64", "break_65_128", "break_129_256", "break_257_512", "break_513_plus")
#: Fixed value: what precedes an id in the digest that orders a partition's cells.
PARTITION_SALT = "stage5_v1|20260924|"


def stratum() -> Column:
    age = F.col("tau_index") + 1
    return F.when(F.col("tau_index") == -1, STRATA[0]).when(age <= 64, STRATA[1]).when(age <= 128, STRATA[2]).when(age <= 256, STRATA[3]).when(age <= 512, STRATA[4]).otherwise(STRATA[5])


def manifest(df: DataFrame) -> DataFrame:
    """One row a series: id, tau_index, lengths, has_break, stratum, and fold, balanced within each stratum by digest order."""
    m = df.groupBy("id").agg(F.max("tau_index").alias("tau_index"), F.count(F.when(F.col("period") == 1, 1)).alias("history_length"), F.count(F.when(F.col("period") == 2, 1)).alias("online_length"))
    m = m.withColumn("has_break", (F.col("tau_index") >= 0).cast("int")).withColumn("stratum", stratum())
    return manifest_folds(m, F.col("id").cast("string"))


def manifest_folds(m: DataFrame, name: Column) -> DataFrame:
    """m with folds, dealt within each stratum in the order of the names' digests."""
    return m.withColumn("fold", (F.row_number().over(W.partitionBy("stratum").orderBy(F.sha2(name, 256), "id")) - 1) % FOLDS)


def folds(df: DataFrame) -> DataFrame:
    """id and fold as manifest(df) has them, from ids and breaks alone: no row's place in its series is needed, so rows need no shuffle."""
    m = df.groupBy("id").agg(F.max("tau_index").alias("tau_index")).withColumn("stratum", stratum())
    return manifest_folds(m, F.col("id").cast("string")).select("id", F.col("fold").cast("int").alias("fold"))


def in_partition(df: DataFrame, halves: DataFrame) -> DataFrame:
    """df with each series' half; a series without one fails the query."""
    x = df.join(halves.select("id", "partition"), "id", "left")
    missing = F.raise_error(F.concat(F.lit("no partition for series "), F.col("id").cast("string"))).cast("string")
    return x.withColumn("partition", F.coalesce("partition", missing))


def fold_balance(m: DataFrame) -> DataFrame:
    """Series by stratum and fold; the largest and least fold of a stratum differ by one at most."""
    return m.groupBy("stratum").agg(*[F.count(F.when(F.col("fold") == k, 1)).alias(f"fold_{k}") for k in range(FOLDS)])


def grouped_folds(m: DataFrame) -> DataFrame:
    """Folds of whole groups (column group): groups in digest order, dealt within each break class."""
    g = m.groupBy("group").agg(F.max("has_break").alias("b"))
    g = g.withColumn("fold", (F.row_number().over(W.partitionBy("b").orderBy(F.sha2(F.col("group").cast("string"), 256), "group")) - 1) % FOLDS)
    return m.drop("fold").join(g.select("group", "fold"), "group")


def partition(m: DataFrame) -> DataFrame:
    """Halves A and B that alternate through strata, folds and digests, so that every cell is split evenly."""
    number = F.array_position(F.array(*[F.lit(s) for s in STRATA]), F.col("stratum"))
    digest = F.sha2(F.concat(F.lit(PARTITION_SALT), F.col("id").cast("string")), 256)
    # The parity of a global rank: ranks within a cell, plus the sizes of the cells before (30 cells).
    inside = F.row_number().over(W.partitionBy("stratum", "fold").orderBy(digest, F.col("id").cast("string"))) - 1
    cells = m.groupBy("stratum", "fold").agg(F.count(F.lit(1)).alias("n")).withColumn("number", number)
    before = F.coalesce(F.sum("n").over(W.orderBy("number", "fold").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("stratum", "fold", before.alias("before"))
    x = m.withColumn("inside", inside).join(F.broadcast(cells), ["stratum", "fold"])
    return x.withColumn("partition", F.when((F.col("before") + F.col("inside")) % 2 == 0, "A").otherwise("B")).drop("inside", "before")


def gate(pooled: float, folds: list[float], late: float | None, early: float | None, least: float = 0.002, positive: int = 4, early_floor: float = -0.005) -> dict[str, bool]:
    """Conditions of an advance: pooled gain, folds that gain, no late loss, a bounded early loss."""
    return {"pooled": pooled >= least, "folds": sum(d > 0 for d in folds) >= positive, "late": late is not None and late >= 0, "early": early is not None and early >= early_floor}


def strict_gate(conditions: dict[str, bool], early_guard: float | None, halves: dict[str, float], replicates=None, child_delta: float | None = None, child_replicates=None, child: bool = False) -> dict:
    """The plain gate, an early guard, gains in both halves, a bootstrap 1 % quantile above 0, and for a child an interval above its parent."""
    c = dict(conditions, early_guard=early_guard is not None and early_guard >= -0.005, half_a=halves.get("A", 0) > 0, half_b=halves.get("B", 0) > 0)
    for r in (replicates, child_replicates):
        if r is not None and (len(r) != 999 or not np.isfinite(r).all()):
            raise ValueError("999 finite replicates are needed")
    low = float(np.quantile(replicates, 0.01)) if replicates is not None else None
    interval = np.quantile(child_replicates, [0.025, 0.975]).tolist() if child_replicates is not None else None
    child_ok = not child or (child_delta is not None and child_delta > 0 and interval is not None and interval[0] > 0)
    return {"conditions": c, "low": low, "interval": interval, "advances": all(c.values()) and low is not None and low > 0 and child_ok}


def winner(results: DataFrame, otherwise: str) -> DataFrame:
    """Of (experiment, ts_auc, inputs, advances): the best score, then fewer inputs, then the lower name; else the incumbent."""
    best = results.filter("advances").orderBy(F.desc("ts_auc"), "inputs", "experiment").limit(1)
    return best.select("experiment").unionByName(results.sparkSession.createDataFrame([(otherwise,)], "experiment string")).limit(1)


def promote(order: list[str], first: str, better) -> tuple[str, list[tuple[str, str, bool]]]:
    """Candidates in order against the champion so far; better(candidate, champion) decides."""
    champion, log = first, []
    for c in order:
        won = bool(better(c, champion))
        log.append((c, champion, won))
        champion = c if won else champion
    return champion, log


def expand(wanted: list[str], needs: dict[str, list[str]]) -> list[str]:
    """wanted and all they need, each after what it needs; a cycle is an error."""
    out: list[str] = []

    def visit(k: str, above: tuple[str, ...]) -> None:
        if k in above:
            raise ValueError(f"cycle at {k}")
        for n in needs.get(k, []):
            visit(n, (*above, k))
        if k not in out:
            out.append(k)

    for k in wanted:
        visit(k, ())
    return out


def groups(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, group (least id linked to it): alternating grouped minima, for pairs (a, b) of related series, until nothing changes."""
    root = f"{shared_dir(nodes.sparkSession)}/groups-{uuid.uuid4().hex}"

    def saved(df: DataFrame, turn: int) -> DataFrame:
        """df written and read back: plans do not grow, and lost executors lose nothing."""
        df.write.parquet(f"{root}/{turn}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{root}/{turn}")

    e = saved(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), 0)
    label = saved(nodes.select("id", F.col("id").alias("group")), 1)
    turn = 1
    while True:
        turn += 1
        near = e.join(label, e["b"] == label["id"]).groupBy("a").agg(F.min("group").alias("g"))
        new = label.join(near, label["id"] == near["a"], "left").select("id", F.least("group", "g").alias("group"))
        # a label's own label: paths halve
        own = new.select(F.col("id").alias("i"), F.col("group").alias("gg"))
        new = saved(new.join(own, new["group"] == own["i"]).select("id", F.least("group", "gg").alias("group")), turn)
        if new.join(label.withColumnRenamed("group", "old"), "id").filter("`group` <> old").isEmpty():
            return new
        label = new


def bootstrap_terms(df: DataFrame, weights: DataFrame, replicates: int, columns: tuple[str, ...]) -> DataFrame:
    """replicate, u_<column>, z: Mann-Whitney sums and pairs over all ages, each row counting weights' times for its series.

    df has id, t, target and the columns; weights has id and w, a byte for each
    replicate. Nothing is collected or broadcast: rows carry their bytes to (age,
    column, range of scores), ranges give sums for every replicate, and the ranges of
    an age, one for RANGE_SERIES series and RANGES at most, are put together in order.
    """
    ranges = max(1, min(RANGES, -(-weights.count() // RANGE_SERIES)))
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("p")) for i, c in enumerate(columns)])).alias("x")
    x = df.select("id", "t", "target", parts).select("id", "t", "target", "x.c", "x.p").join(weights, "id").withColumn("r", F.floor(score_range(F.col("p")) * ranges / RANGES).cast("int"))

    def inside(key, pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.frombuffer(b"".join(pdf["w"]), np.uint8).reshape(len(pdf), -1)[:, :replicates]
        score, y = pdf["p"].to_numpy(), pdf["target"].to_numpy(float)
        o = np.argsort(score, kind="stable")
        first = np.flatnonzero(np.diff(score[o], prepend=np.nan) != 0)
        u, pos, neg = [], [], []
        for at in range(0, replicates, 64):
            k = w[o, at : at + 64].astype(float)
            a, b = np.add.reduceat(k * y[o, None], first, axis=0), np.add.reduceat(k * (1 - y[o, None]), first, axis=0)
            u.append((a * (np.cumsum(b, 0) - b / 2)).sum(0))
            pos.append(a.sum(0))
            neg.append(b.sum(0))
        t, c, r = key
        return pd.DataFrame({"t": [t], "c": [c], "r": [r], "u": [np.concatenate(u)], "pos": [np.concatenate(pos)], "neg": [np.concatenate(neg)]})

    def ages(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        u, pos, neg = (np.stack(pdf[c]) for c in ("u", "pos", "neg"))
        below = np.cumsum(neg, 0) - neg
        return pd.DataFrame({"c": key[1], "replicate": np.arange(replicates), "u": (u + pos * below).sum(0), "z": pos.sum(0) * neg.sum(0)})

    summed = x.groupBy("t", "c", "r").applyInPandas(inside, "t int, c int, r int, u array<double>, pos array<double>, neg array<double>")
    each = summed.groupBy("t", "c").applyInPandas(ages, "c int, replicate long, u double, z double")
    own = [F.sum(F.when(F.col("c") == i, F.col("u"))).alias(f"u_{c}") for i, c in enumerate(columns)]
    return each.groupBy("replicate").agg(*own, F.sum(F.when(F.col("c") == 0, F.col("z"))).alias("z"))


def multiplicities(m: DataFrame, replicates: int, seed: int) -> DataFrame:
    """id, w: how often each series is drawn in each replicate (a byte each, from 0), as many draws as its stratum has series, from that stratum.

    Draw j of a stratum's replicate is a hash, so the draws are the same wherever they are made.
    """
    ranked = m.select("id", "stratum", (F.row_number().over(W.partitionBy("stratum").orderBy(F.col("id").cast("string"), "id")) - 1).alias("j"), F.count(F.lit(1)).over(W.partitionBy("stratum")).alias("n"))
    drawn = ranked.select("stratum", "j", "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))
    drawn = drawn.select("stratum", "b", F.pmod(F.xxhash64("stratum", "j", "b", F.lit(seed)), F.col("n")).alias("j"))
    times = drawn.groupBy("stratum", "j", "b").agg(F.count(F.lit(1)).alias("k")).groupBy("stratum", "j").agg(F.map_from_entries(F.collect_list(F.struct("b", "k"))).alias("k"))  # replicates entries at most
    hexes = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda b: F.lpad(F.hex(F.least(F.coalesce(F.col("k")[b], F.lit(0)), F.lit(255))), 2, "0"))
    return ranked.join(times, ["stratum", "j"], "left").select("id", F.unhex(F.array_join(hexes, "")).alias("w"))


def paired_bootstrap(df: DataFrame, m: DataFrame, candidate: str, reference: str, replicates: int = 999, seed: int = 20260922) -> DataFrame:
    """replicate, delta: difference of the two columns' scores when series are drawn anew, whole and within their strata."""
    both = df.select("id", "t", "target", F.col(candidate).alias("a"), F.col(reference).alias("b"))
    g = bootstrap_terms(both, multiplicities(m, replicates, seed), replicates, ("a", "b"))
    return g.select("replicate", F.coalesce(F.try_divide(F.col("u_a") - F.col("u_b"), "z"), F.lit(0.0)).alias("delta"))
