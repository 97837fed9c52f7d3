"""The pipeline stage by stage on the small tables, against what each stage may and must do."""

import collections

import pandas as pd
import pytest

import corpus_pipeline as pipe


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    from tidemark.llm.common import Scratch

    scratch, docs, out = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    out["documents"] = docs.toPandas()
    for name, f in pipe.STAGES:
        docs = scratch.save(f(spark, docs, sf_dir), name)
        out[name] = docs.toPandas()
    return out


def test_columns_and_order(stages):
    names = [n for n, _ in pipe.STAGES]
    assert names == ["toxicity", "near_duplicates", "repeated_passages", "source_mixing", "packing"]
    for n in names[:-1]:
        assert sorted(stages[n].columns) == sorted(stages["documents"].columns)


def test_clean_documents_stay(stages, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    clean = set(labels[labels.toxic == 0].doc_id) & set(stages["documents"].doc_id)
    assert len(clean & set(stages["toxicity"].doc_id)) >= 0.8 * len(clean)
    assert len(stages["repeated_passages"]) == len(stages["near_duplicates"])
    assert set(stages["source_mixing"].doc_id) == set(stages["repeated_passages"].doc_id)


def test_one_of_each_exact_copy_stays(stages):
    before, after = stages["toxicity"], stages["near_duplicates"]
    assert not after.text.duplicated().any()
    firsts = before.groupby("text").doc_id.min()
    assert set(after.doc_id) <= set(firsts)


def test_texts_only_shrink(stages):
    m = stages["near_duplicates"].merge(stages["repeated_passages"], on="doc_id", suffixes=("", "_after"))
    assert (m.text_after.str.len() <= m.text.str.len()).all()
    assert (m.n_chars_after == m.text_after.str.len()).all()


def test_packing_holds_every_copy(stages):
    p, docs = stages["packing"], stages["source_mixing"]
    copies = collections.Counter(docs.doc_id)
    assert collections.Counter(p[p.piece == 0].doc_id) == copies
    for _, g in p.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]]


def test_run_equals_the_stages(spark, sf_dir, stages):
    got = pipe.run(spark, sf_dir).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    a, b = (pd.DataFrame(x[key]).sort_values(key, ignore_index=True) for x in (got, stages["packing"]))
    pd.testing.assert_frame_equal(a, b)


def test_nulls_repeated_rows_extra_columns_and_empty_tables(spark, tmp_path):
    """Every stage takes nulls in any column, rows without id, repeated rows and columns of clashing names; and empty tables."""
    good = "the quick brown fox jumps over the lazy dog and runs far away from the old barn at dusk today"
    rows = [(k, f"{good} number {k} of many {k * 7} words", None if k % 3 else "en", None if k % 2 else "s", None) for k in range(30)]
    rows += [(None, good, None, None, None), (None, good, None, None, None), (3, rows[3][1], "en", "s", 5), (40, None, None, None, None), (41, "", "en", "s", 0), (42, "word " * 3000, "en", "s", 1), rows[4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 as r", "2 as copies", "'x' as _c0", "0.5 as score")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(30)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = pipe.run(spark, str(tmp_path)).toPandas()
    assert {*range(30), 40, 41, 42} >= set(out.doc_id.dropna().astype(int)) and out.doc_id.isna().any()
    assert {40, 41, 42} <= set(out.doc_id.dropna())
    for name, stage in pipe.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == list(pipe.COLUMNS), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    kept = pipe.one_of_each_group(spark, docs, str(tmp_path))
    assert kept.filter("doc_id is null").count() == 1 and kept.filter("doc_id = 3").count() == 1  # one row of each group
    assert pipe.pack(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_batches_to_python_are_bounded_by_bytes(spark):
    """Long texts go to Python a few megabytes at a time, whatever their number."""
    import pyarrow as pa

    from tidemark.llm import common

    docs = spark.range(0, 2000, 1, 1).selectExpr("id as doc_id", "repeat('abcdefgh ', 5000) as text")
    name, small = "spark.sql.execution.arrow.maxBytesPerBatch", common.BATCH_BYTES
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, str(1 << 28))
        common.Scratch(spark)

        def size(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], ["rows", "bytes"])

        found = docs.select("text").mapInArrow(size, "rows long, bytes long").toPandas()
        assert found["rows"].sum() == 2000 and found["bytes"].max() < 2 * small
    finally:
        spark.conf.set(name, before)
