"""The two entry points of production, train and infer, and the commands."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import audits, blocks, decisions, detectors, models, profile, scoring
from .sources import artifacts, series
from .streaming import blocks as streams

#: What an experiment needs computed.
NEEDS = {e: "base" if e in ("E08", "E09", "E10", "E11", "E12") else "scale" if e in ("E14", "E15", "E16", "E17") else "normal" for e in models.EXTRAS}


def train(frame: DataFrame, folder: str, experiment: str = "E14") -> dict:
    """Fit an experiment on all series of a labelled frame and bundle the model."""
    path = f"{folder}-features"
    artifacts.write_table(blocks.features(frame, NEEDS[experiment]), path)
    model = models.fit(frame.sparkSession.read.parquet(path), experiment)
    artifacts.write_bundle(folder, models.dumps(model), {"experiment": experiment, "versions": artifacts.versions(frame.sparkSession)})
    return model


def infer(frame: DataFrame, folder: str) -> DataFrame:
    """id, t, prediction for every online row; labels are not needed."""
    model = models.loads(artifacts.read_bundle(folder))
    return models.predict(blocks.features(frame, NEEDS[model["experiment"]]), model).select("id", "t", "prediction")


def backtest(frame: DataFrame, name: str) -> DataFrame:
    """id, t, target, fold, prediction of a detector, a block mean, or an out-of-fold model."""
    folds = decisions.manifest(frame).select("id", "fold")
    if name in detectors.DETECTORS:
        out = detectors.detect(frame, name).withColumnRenamed(name, "prediction").join(folds, "id")
    elif name in blocks.EXPERIMENTS:
        out = blocks.experiment(frame, name).join(folds, "id")
    else:
        out = models.out_of_fold(blocks.features(frame, NEEDS[name]).join(folds, "id"), name)
    return out.select("id", "t", "target", "fold", "prediction")


def infer_stream(points: DataFrame, refs: DataFrame, folder: str) -> DataFrame:
    """id, ordinal, t, prediction for streaming points, from references of the histories (streams.references) and a bundled E08 or E14 model."""
    model = models.loads(artifacts.read_bundle(folder))
    if model["experiment"] not in ("E08", "E14"):
        raise ValueError(f"{model['experiment']} needs blocks that do not stream")
    return streams.infer(points, refs, model)


def compare(frame: DataFrame, predictions: DataFrame, parents: DataFrame, replicates: int = 999) -> dict:
    """Deltas by fold, age and half, the strict gate, and the bootstrap's 1 % quantile and interval, of predictions against parents on the same keys."""
    keys = frame.filter("period = 2").select("id", "t")
    both = audits.one_to_one(scoring.expected(predictions, keys).select("id", "t", "target", "fold", "prediction"), scoring.expected(parents, keys).select("id", "t", F.col("prediction").alias("parent")), ["id", "t"])
    a, b = scoring.pair_terms(both), scoring.pair_terms(both, "parent")
    m = decisions.manifest(frame)
    halves = decisions.in_partition(both, decisions.partition(m))
    delta = lambda x, y, key: {r[key]: r["delta"] for r in scoring.difference(x, y, key).collect()}
    folds = delta(scoring.pooled_and_folds(both), scoring.pooled_and_folds(both, "parent"), "fold")
    ages = delta(scoring.combined(a), scoring.combined(b), "ages")
    parts = delta(scoring.ts_auc(halves, "prediction", ("partition",)), scoring.ts_auc(halves, "parent", ("partition",)), "partition")
    gate = decisions.gate(folds[-1], [v for k, v in folds.items() if k >= 0], ages.get("ge129"), ages.get("le64"))
    out = {"folds": folds, "ages": ages, "halves": parts, "gate": gate}
    draws = None
    if all(gate.values()):
        d = decisions.paired_bootstrap(both, m, "prediction", "parent", replicates)
        draws = np.array([r["delta"] for r in d.orderBy("replicate").collect()])  # one number a replicate
        out["interval"] = list(audits.interval(draws))
    strict = decisions.strict_gate(gate, ages.get("le64"), parts, draws if draws is not None and len(draws) == 999 else None)
    return out | {"low": strict["low"], "advances": strict["advances"]}


def champion(frame: DataFrame, predictions: dict[str, DataFrame], first: str) -> tuple[str, list]:
    """The experiment that is left when each of the others, in order, meets the champion so far under the strict gate."""
    return decisions.promote([k for k in predictions if k != first], first, lambda new, old: compare(frame, predictions[new], predictions[old])["advances"])


def _source(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.cache:
        return artifacts.prepare(spark, a.x, a.y, a.index, a.cache)
    return series.from_lineitem(spark, a.tables)


def _rescore(frame: DataFrame, done: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Scores of finished predictions, pooled and by folds, of whole groups if there are any."""
    m = decisions.manifest(frame)
    folds = m if groups is None else decisions.grouped_folds(m.join(groups, "id"))
    return scoring.pooled_and_folds(scoring.expected(done.drop("fold"), frame.filter("period = 2").select("id", "t")).join(folds.select("id", "fold"), "id"))


COMMANDS = ("profile", "backtest", "train", "infer", "synthetic", "folds", "partition", "rescore", "compare", "export", "verify", "package")


def main(argv: list[str] | None = None) -> None:
    from . import session

    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("name", nargs="?", default="squared", help="detector or experiment")
    for o in ("x", "y", "index", "cache", "tables", "bundle", "master", "groups", "predictions", "parents"):
        p.add_argument(f"--{o}")
    p.add_argument("--out", required=True)
    a = p.parse_args(argv)
    out = Path(a.out)
    if a.command == "verify":  # files on the driver: no session
        print(json.dumps(artifacts.verify(out), indent=1))
        return
    if a.command == "package":
        files = artifacts.verify(a.bundle)
        artifacts.package(a.bundle, out, (*files, artifacts.MANIFEST))
        return
    spark = session.build(a.master)
    if a.command == "synthetic":
        for n, df in zip(("x", "y", "index"), series.synthetic(spark), strict=True):
            df.drop("ordinal").coalesce(1).write.parquet(f"{a.out}/{n}.parquet")
        return
    frame = _source(spark, a)
    manifest = decisions.manifest(frame)
    groups = series.read_groups(spark, a.groups, manifest) if a.groups else None
    if a.command == "train":
        train(frame, a.out, a.name)
    elif a.command == "infer":
        artifacts.write_table(infer(frame, a.bundle), a.out, ["id", "t"], "id")
    elif a.command == "folds":
        named = manifest.withColumn("id", F.col("id").cast("string"))
        artifacts.write_csv(named if groups is None else decisions.grouped_folds(named.join(groups, "id")), a.out)
    elif a.command == "partition":
        artifacts.write_table(decisions.partition(manifest).select("id", "stratum", "fold", "partition"), a.out)
    elif a.command == "rescore":
        artifacts.write_table(_rescore(frame, spark.read.parquet(a.predictions), groups), a.out)
    elif a.command == "compare":
        artifacts.write_json(out, compare(frame, spark.read.parquet(a.predictions), spark.read.parquet(a.parents)), indent=1)
    elif a.command == "export":
        f = blocks.features(frame, "normal").join(manifest.select("id", "fold"), "id")
        evaluator = [c for c in ("target", "tau_index", "fold") if c in f.columns]
        artifacts.write_export(f, a.out, [c for c in f.columns if c not in ("id", "t", *evaluator)], evaluator)
    elif a.command == "profile":
        past = frame.filter("period = 1")
        tables = {"history": profile.series_statistics(past), "autocorrelations": profile.autocorrelations(past), "signatures": profile.signature(frame), "ages": profile.age_support(frame)}
        for n, df in tables.items():
            artifacts.write_table(df, f"{a.out}/{n}")
    else:
        artifacts.write_table(backtest(frame, a.name), f"{a.out}/predictions", ["id", "t"], "id")
        done = spark.read.parquet(f"{a.out}/predictions")
        terms = scoring.pair_terms(done).persist()
        artifacts.report(out / "report.md", a.name, {"folds": scoring.pooled_and_folds(done), "age buckets": scoring.buckets(terms), "combined ages": scoring.combined(terms)})


if __name__ == "__main__":
    main()
