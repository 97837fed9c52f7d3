"""The metric, weights, models and decisions against brute force and fixed cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import decisions, integrity, models, profile, scoring
from tidemark.sources import series as source


def brute(df):
    u = w = 0.0
    for _, g in df.groupby("t"):
        p, n = g[g.target == 1].prediction.to_numpy(), g[g.target == 0].prediction.to_numpy()
        u += ((p[:, None] > n[None]) + 0.5 * (p[:, None] == n[None])).sum()
        w += len(p) * len(n)
    return u / w if w else 0.5


def random_frame(seed, series=40):
    r = np.random.default_rng(seed)
    out = []
    for i in range(series):
        tau = r.integers(0, 10)
        for t in range(r.integers(4, 17)):
            out.append((i, t, int(i % 2 and t >= tau), round(float(r.random()), 1), i % 5, *r.random(4)))
    return pd.DataFrame(out, columns=["id", "t", "target", "prediction", "fold", *models.BASE])


def test_hand_case(spark):
    rows = [(1, 0, 1, 0.9), (2, 0, 0, 0.1), (1, 1, 1, 0.5), (2, 1, 0, 0.5), (3, 1, 0, 0.7), (4, 1, 1, 0.9)]
    df = pd.DataFrame(rows, columns=["id", "t", "target", "prediction"])
    assert scoring.ts_auc(spark.createDataFrame(df)).first()["ts_auc"] == pytest.approx(brute(df))


@pytest.mark.parametrize("seed", range(3))
def test_random_ties(spark, seed):
    df = random_frame(seed)
    assert scoring.ts_auc(spark.createDataFrame(df)).first()["ts_auc"] == pytest.approx(brute(df), abs=1e-12)


def test_no_pairs_is_a_half(spark):
    df = spark.createDataFrame([(1, 0, 1, 0.3)], "id long, t int, target int, prediction double")
    assert scoring.ts_auc(df).first()["ts_auc"] == 0.5
    assert scoring.ts_auc(df.limit(0)).first()["ts_auc"] == 0.5


def test_weight_identities(spark):
    df = spark.createDataFrame(random_frame(4))
    a = scoring.weight_audit(df).toPandas()
    assert a["mass"].sum() == pytest.approx(1, abs=1e-12)
    assert np.abs(a["mass"] - a["expected_mass"]).max() < 1e-12
    assert np.abs(a["positive_mass"] - a["expected_mass"] / 2).max() < 1e-12


def test_logistic_converges_and_ignores_held_out_rows(spark):
    f = random_frame(5).assign(mse_ratio=0.9)
    df = spark.createDataFrame(f)
    m = models.fit(df.filter("fold <> 0"), "E08")
    assert models.gradient(df.filter("fold <> 0"), m).agg(F.max(F.abs("gradient"))).first()[0] < 1e-6
    f.loc[f.fold == 0, "blk_r"] = 0.123
    again = models.fit(spark.createDataFrame(f).filter("fold <> 0"), "E08")
    assert again["slopes"] == pytest.approx(m["slopes"])
    assert models.loads(models.dumps(m))["slopes"] == m["slopes"]
    assert set(models.raw_slopes(m)) == set(m["slopes"])


def test_predictions_are_the_formula(spark):
    f = random_frame(6).assign(mse_ratio=0.9)
    df = spark.createDataFrame(f)
    m = models.fit(df, "E12")
    p = models.predict(df, m).toPandas().sort_values(["id", "t"])["prediction"].to_numpy()
    f = f.sort_values(["id", "t"])
    z = {c: (f[c] - m["base"][c][0]) / m["base"][c][1] for c in models.BASE}
    logit = m["intercept"] + sum(m["slopes"][f"z_{c}"] * z[c] for c in models.BASE)
    for n, c in (("a_i", "blk_i"), ("a_p", "blk_p"), ("a_d", "blk_d")):
        x = (np.log1p(f.t + 1) - m["a"]) * z[c]
        logit = logit + m["slopes"][f"zx_{n}"] * (x - m["extra"][n][0]) / m["extra"][n][1]
    assert np.abs(p - (1 / (1 + np.exp(-logit))).to_numpy()).max() < 1e-9


def test_constant_input_has_no_weight(spark):
    df = spark.createDataFrame(random_frame(7).assign(blk_d=0.4, mse_ratio=1.0))
    m = models.fit(df, "E08")
    assert m["base"]["blk_d"] == (0.4, 0.0)


def test_strata_edges(spark):
    tau = [-1, 0, 63, 64, 127, 128, 255, 256, 511, 512]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(tau)], ["i", "tau_index"]).orderBy("i").select(decisions.stratum()).collect()]
    s = decisions.STRATA
    assert got == [s[0], s[1], s[1], s[2], s[2], s[3], s[3], s[4], s[4], s[5]]


def test_folds_and_partition_are_even(spark, sf_dir):
    m = spark.createDataFrame(pd.DataFrame({"id": range(90), "tau_index": [(-1, 10, 70, 140, 300, 600)[i % 6] for i in range(90)]}))
    m = decisions.manifest(m.withColumns({"period": F.lit(2), "k": F.lit(0)}))
    b = decisions.fold_balance(m).toPandas()[[f"fold_{k}" for k in range(5)]].to_numpy()
    assert (b.max(1) - b.min(1) <= 1).all()
    p = decisions.partition(m).groupBy("partition").count().toPandas()
    assert sorted(p["count"]) == [45, 45]
    c = decisions.partition(m).groupBy("stratum", "fold", "partition").count().toPandas().pivot_table(index=["stratum", "fold"], columns="partition", values="count", fill_value=0)
    assert ((c["A"] - c["B"]).abs() <= 1).all()


def test_bootstrap_equals_physical_copies(spark):
    f = random_frame(8)
    f["reference"] = f["blk_r"].round(1)
    df = spark.createDataFrame(f)
    m = spark.createDataFrame(pd.DataFrame({"id": range(40), "stratum": [decisions.STRATA[i % 2] for i in range(40)]}))
    got = decisions.paired_bootstrap(df, m, "prediction", "reference", replicates=3, seed=5).toPandas().set_index("replicate")["delta"]
    draws = {r["id"]: r["w"] for r in decisions.multiplicities(m, 3, 5).collect()}
    for b in range(3):
        for parity in (0, 1):  # a stratum's series are drawn as often as it has some
            assert sum(w[b] for i, w in draws.items() if i % 2 == parity) == 20
        rows = pd.concat([f[f.id == i] for i, w in draws.items() for _ in range(w[b])])
        want = brute(rows) - brute(rows.assign(prediction=rows.reference))
        assert got[b] == pytest.approx(want, abs=1e-12)


def test_gates():
    assert all(decisions.gate(0.002, [1, 1, 1, 1, -1], 0.0, -0.005).values())
    assert not decisions.gate(0.0019, [1, 1, 1, 1, -1], 0.0, -0.005)["pooled"]
    assert not decisions.gate(0.002, [1, 1, 1, 0, -1], 0.0, -0.005)["folds"]
    assert not decisions.gate(0.002, [1] * 5, None, -0.0051)["early"]
    g = decisions.strict_gate(decisions.gate(0.01, [1] * 5, 0.1, 0.1), 0.0, {"A": 1, "B": 1}, np.full(999, 0.001))
    assert g["advances"]
    assert decisions.promote(["a", "b", "c"], "z", lambda c, p: c != "b")[0] == "c"
    assert decisions.expand(["E05"], {"E05": ["E03", "E04"], "E04": ["E03"]}) == ["E03", "E04", "E05"]
    with pytest.raises(ValueError):
        decisions.expand(["a"], {"a": ["a"]})


def test_synthetic_tables_are_sound_and_faults_are_found(spark):
    x, y, i = source.synthetic(spark)
    integrity.require_sound(x, y, i)
    with pytest.raises(ValueError, match="twice_y"):
        integrity.require_sound(x, y.union(y.limit(1)), i)
    s = source.from_long(x, y, i)
    a = integrity.label_alignment(s).toPandas()
    assert (a["match_same"] == 1).all() and (a["falls"] == 0).all()
    moved = source.from_long(x, y, i.withColumn("tau_index", F.when(F.col("tau_index") >= 0, F.col("tau_index") + 1).otherwise(-1)))
    b = integrity.label_alignment(moved).filter("tau_index >= 0").toPandas()
    assert (b["offset"] == -1).all()
    assert source.out_of_order(x).agg(F.sum("backward")).first()[0] == 0


def test_related_series(spark):
    r = np.random.default_rng(2)
    base = {i: r.normal(size=300) for i in range(6)}
    base[10], base[11] = base[0].copy(), base[1] + r.normal(size=300) * 1e-4
    rows = [(i, k, float(v), 300, 300, 1) for i, x in base.items() for k, v in enumerate(x)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["id", "k", "value", "n", "H", "period"]))
    assert {(d["id"], d["first"]) for d in profile.duplicate_histories(df).collect()} == {(10, 0)}
    near = {(p["a"], p["b"]) for p in profile.verify_near(df, profile.near_candidates(df)).collect()}
    assert near == {(0, 10), (1, 11)}
    g = {x["id"]: x["group"] for x in decisions.groups(df.select("id").distinct(), spark.createDataFrame(list(near), ["a", "b"])).collect()}
    assert g[10] == 0 and g[11] == 1 and g[2] == 2
    assert {(b["a"], b["b"], b["blocks"]) for b in profile.repeated_blocks(df).collect()} == {(0, 10, 2)}


def test_boosted_query_fits_as_long_as_the_operator(monkeypatch):
    from tidemark.plans import queries

    asked = []
    monkeypatch.setattr(queries, "_frame", lambda s, d, through: through)
    monkeypatch.setattr(queries.models, "boosted", lambda df, **settings: asked.append((df, settings)))
    monkeypatch.setattr(queries.scoring, "pooled_and_folds", lambda df: df)
    queries.QUERIES["model_E13_boosted"](None, "")
    assert asked == [("base", {})]


def test_near_candidates_lose_no_near_pair(spark):
    """All pairs within the limit, by brute force, are among the candidates; lists longer than any fixed number of neighbours too."""
    r = np.random.default_rng(3)
    base = [r.normal(size=203) for _ in range(4)]
    x = {i: base[i % 4] + r.normal(size=203) * r.choice([1e-3, 5e-3, 9e-3, 0.02]) for i in range(36)}
    rows = [(i, k, float(v), 203, 203, 1) for i, s in x.items() for k, v in enumerate(s)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["id", "k", "value", "n", "H", "period"]))
    z = {i: (s - s.mean()) / s.std() for i, s in x.items()}
    want = {(a, b) for a in x for b in x if a < b and np.sqrt(((z[a] - z[b]) ** 2).mean()) <= profile.NEAR_RMS}
    assert len(want) > 40
    candidates = profile.near_candidates(df)
    assert want <= {(p["a"], p["b"]) for p in candidates.collect()}
    assert {(p["a"], p["b"]) for p in profile.verify_near(df, candidates).collect()} == want


def test_joins_and_frames_that_are_not_whole_fail(spark):
    from tidemark.operators import audits

    a = spark.createDataFrame([(1, 0, 1, 0.5), (1, 1, 0, 0.25)], "id int, t int, target int, prediction double")
    assert audits.one_to_one(a, a.select("id", "t", F.lit(1).alias("n")), ["id", "t"]).count() == 2
    for other in (a.limit(1), a.union(a.limit(1))):
        with pytest.raises(ValueError, match="keys"):
            audits.one_to_one(a, other.select("id", "t", F.lit(1).alias("n")), ["id", "t"])
    assert scoring.expected(a, a.select("id", "t")).count() == 2
    with pytest.raises(ValueError, match="missing"):
        scoring.expected(a.limit(1), a.select("id", "t"))
    with pytest.raises(Exception, match="no partition"):
        decisions.in_partition(a, spark.createDataFrame([(2, "A")], "id int, partition string")).collect()


def test_ranges_of_scores_give_the_same_terms(spark, monkeypatch):
    f = random_frame(11)
    f["prediction"] = f["prediction"] * 4 - 1.5  # scores outside the unit interval too
    df = spark.createDataFrame(f)
    one = lambda: sorted(tuple(r) for r in scoring.pair_terms(df).collect())
    many = one()
    monkeypatch.setattr(scoring, "RANGES", 1)
    assert one() == many
