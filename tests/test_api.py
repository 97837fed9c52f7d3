"""The commands on small tables, from backtests to a comparison."""

import json

import pytest

from tidemark import api


def test_backtest_folds_partition_rescore_and_compare(spark, sf_dir, tmp_path, monkeypatch):
    from tidemark import session

    monkeypatch.setattr(session, "build", lambda master=None: spark)
    run = lambda *a: api.main([*map(str, a), "--tables", sf_dir])
    for name in ("squared", "cusum"):
        run("backtest", name, "--out", tmp_path / name)
    run("folds", "--out", tmp_path / "folds")
    run("partition", "--out", tmp_path / "halves")
    ids = {r["id"] for r in spark.read.csv(str(tmp_path / "folds"), header=True).collect()}
    assert {str(r["id"]) for r in spark.read.parquet(str(tmp_path / "halves")).collect()} == ids
    (tmp_path / "groups.csv").write_text("id,group\n" + "".join(f"{i},g{int(i) // 2}\n" for i in sorted(ids)))
    run("folds", "--groups", tmp_path / "groups.csv", "--out", tmp_path / "grouped")
    grouped = spark.read.csv(str(tmp_path / "grouped"), header=True).toPandas()
    assert (grouped.groupby("group").fold.nunique() == 1).all() and set(grouped.id) == ids
    run("rescore", "--predictions", tmp_path / "squared" / "predictions", "--out", tmp_path / "again")
    assert {r["fold"] for r in spark.read.parquet(str(tmp_path / "again")).collect()} >= {-1, 0}
    run("compare", "--predictions", tmp_path / "squared" / "predictions", "--parents", tmp_path / "cusum" / "predictions", "--out", tmp_path / "c.json")
    found = json.loads((tmp_path / "c.json").read_text())
    assert {"folds", "ages", "halves", "gate", "advances"} <= set(found)
    with pytest.raises(ValueError, match="missing"):
        whole = spark.read.parquet(str(tmp_path / "squared" / "predictions"))
        api.compare(api.series.from_lineitem(spark, sf_dir), whole.filter("t > 0"), whole)
