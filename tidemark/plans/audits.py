"""Audits, comparisons and block streams as queries, with the same rows in SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits, batch, blocks, decisions, models, profile, scoring
from ..sources.series import from_lineitem
from ..streaming import blocks as streams
from .queries import _frame, register, score_frame, shared_folder, six
from .sql import REF, auc_terms, r6

_LEVELS = {n: f"quantile_cont({{}}, {q})" for n, q in audits.LEVELS.items()}


def _levels(x: str) -> str:
    return ", ".join(r6(sql.format(x), f'"{n}"') for n, sql in _LEVELS.items())


register(
    "component_audit",
    lambda s, d: audits.components(from_lineitem(s, d)),
    " union all ".join(f"select 'blk_{b}' as component, count(*) as rows, 0 as unmatched, 0 as differing from base" for b in "ripd"),
)
register(
    "length_spread",
    lambda s, d: six(audits.spread(decisions.manifest(from_lineitem(s, d)), "online_length", "stratum"), ["stratum", "max"], ["p50", "p95"]),
    f"select stratum, max(online_length) as max, {r6('quantile_cont(online_length, 0.5)', 'p50')}, {r6('quantile_cont(online_length, 0.95)', 'p95')} from manifest group by stratum",
)

_AGAINST = {"c_s": ("blk_i",), "c_f": ("blk_i",), "c_r": ("blk_i",), "k_s": ("blk_i", "blk_p")}
_MADE = {"c_s": "(blk_js - blk_i)", "c_f": "(blk_jf - blk_i)", "c_r": "(blk_jr - blk_i)", "k_s": "(blk_ps - blk_p)"}


def _contrasts(s: SparkSession, d: str) -> DataFrame:
    """The extensions and what they are held against: made once, written, and read by every pass."""
    path = f"{shared_folder(s)}/contrasts"
    batch.features(from_lineitem(s, d), (*_AGAINST, "blk_i", "blk_p")).drop("id", "t").write.option("compression", "zstd").parquet(path)
    return s.read.parquet(path)


register(
    "extension_correlations",
    lambda s, d: six(
        audits.extensions(_contrasts(s, d), _AGAINST),
        ["extension", "against"],
        [*audits.LEVELS, "correlation"],
    ),
    " union all ".join(
        f"select '{e}' as extension, '{o}' as against, {_levels('x')}, {r6('corr(x, y)', 'correlation')}"
        f" from (select {_MADE[e]} / sqrt(2.0::double) as x, {o} as y from jall)"
        for e, others in _AGAINST.items()
        for o in others
    ),
)


def _dependence_sql(step: str, value: str, name: str) -> str:
    return (
        f"(select id, case when count(b) >= 4 then corr(v, b) end as {name} from (select id, v, lag(v) over (partition by id order by k) as b"
        f" from (select id, k, {value} as v from {step} where {REF})) where b is not null group by id)"
    )


_DEPENDENCE = ["before", "after_s", "after_f", "after_r"]
register(
    "squared_dependence",
    lambda s, d: six(audits.squared_dependence(from_lineitem(s, d)), ["id", "context"], _DEPENDENCE),
    "select id, case when before is null then 'unsupported' when before <= 0.1 then 'le0.1' else 'gt0.1' end as context, "
    + ", ".join(r6(c) for c in _DEPENDENCE)
    + f" from {_dependence_sql('scs', 'r * r', 'before')}"
    + "".join(f" join {_dependence_sql(f'sc{k}', f'pow(a_{k}, 2)', f'after_{k}')} using (id)" for k in "sfr"),
)


def _changes(s: SparkSession, d: str) -> DataFrame:
    x = audits.squared_dependence(from_lineitem(s, d))
    return profile.distribution(x.withColumns({f"change_{k}": F.col(f"after_{k}") - F.col("before") for k in "sfr"}), [f"change_{k}" for k in "sfr"])


register(
    "squared_dependence_changes",
    lambda s, d: six(_changes(s, d), ["statistic", "count", "valid", "nonfinite"], [*profile.TABLE, "mean"]),
    " union all ".join(
        f"""select 'change_{k}' as statistic, count(*) as "count", count(x) as valid, count(*) - count(x) as nonfinite, """
        + ", ".join(r6(f"quantile_cont(x, {q})", f'"{n}"') for n, q in profile.TABLE.items())
        + f", {r6('avg(x)', 'mean')} from (select after_{k} - before as x from {_dependence_sql('scs', 'r * r', 'before')}"
        + f" join {_dependence_sql(f'sc{k}', f'pow(a_{k}, 2)', f'after_{k}')} using (id))"
        for k in "sfr"
    ),
)

_REFS = {"c_rows": "count(nz)", "u_min": "min(u_s)", "u_max": "max(u_s)", "z_mean": "avg(nz)", "z_sd": "stddev_samp(nz)", "v0": "max(nz_v0)", "eta": "max(hac_eta)"}
register(
    "reference_distributions",
    lambda s, d: six(audits.reference_distributions(from_lineitem(s, d)), ["statistic", "count", "valid", "nonfinite"], [*profile.TABLE, "mean"]),
    " union all ".join(
        f"""select '{c}' as statistic, count(*) as "count", count(x) as valid, 0 as nonfinite, """
        + ", ".join(r6(f"quantile_cont(x::double, {q})", f'"{n}"') for n, q in profile.TABLE.items())
        + f", {r6('avg(x)', 'mean')} from (select {v} as x from nz join hac using (id) where {REF} group by id)"
        for c, v in _REFS.items()
    ),
)
register("scale_replay", lambda s, d: audits.scale_replay(from_lineitem(s, d)), "select id, count(*) as rows, 0 as mismatches from scs where k >= 5 group by id")

_NULL = [*blocks.MOMENTS, "l_plus", "l_minus", "c_plus", "c_minus"]
register(
    "historical_null",
    lambda s, d: six(audits.null_levels(from_lineitem(s, d)), ["feature", "rows"], [*audits.LEVELS, "at_zero", "at_one", "ge_099"]),
    " union all ".join(
        f"select '{c}' as feature, count(*) as rows, {_levels(c)}, {r6(f'avg(({c} <= 1e-9)::int)', 'at_zero')}, {r6(f'avg(({c} = 1)::int)', 'at_one')},"
        f" {r6(f'avg(({c} >= 0.99)::int)', 'ge_099')} from {f'null_mom_{c}' if c in blocks.MOMENTS else 'null_lik'}"
        for c in _NULL
    ),
)
register(
    "omnibus_moments",
    lambda s, d: six(
        blocks.features(from_lineitem(s, d), only=("m",)).withColumn("mean_m", sum((F.col(m) for m in blocks.MOMENTS[1:]), F.col("m1")) / 5),
        ["id", "t"],
        ["mean_m"],
    ),
    f"select id, k - h as t, {r6('(m1 + m2 + m3 + m4 + m5) / 5', 'mean_m')} from mom_m1 "
    + " ".join(f"join mom_{m} using (id, k)" for m in blocks.MOMENTS[1:])
    + " join (select id, k, h from nz where period = 2) using (id, k)",
)


def replayed(s: SparkSession, d: str) -> DataFrame:
    """The same features from two runs: exactly the same rows."""
    one = lambda: blocks.features(from_lineitem(s, d), only=("r", "i"))
    return audits.agreement(one(), one().repartition(7), ["id", "t"], ["blk_r", "blk_i"])


register("determinism_replay", replayed, " union all ".join(f"select '{c}' as component, count(*) as rows, 0 as unmatched, 0 as differing from base" for c in ("blk_r", "blk_i")))

# Folds anew, and predictions against their labels

_SALT = "rescore|"


def new_folds(m: DataFrame) -> DataFrame:
    """The manifest with folds dealt in the order of another digest."""
    return decisions.manifest_folds(m.drop("fold"), F.concat(F.lit(_SALT), F.col("id").cast("string")))


def rescored(s: SparkSession, d: str) -> DataFrame:
    x, folds = score_frame(s, d), new_folds(decisions.manifest(from_lineitem(s, d))).select("id", "fold")
    again = x.drop("fold").join(folds, "id")
    same = audits.agreement(x, again, ["id", "t"], ["candidate"]).select((F.col("unmatched") + F.col("differing")).alias("changed"))
    return scoring.pooled_and_folds(again, "candidate").crossJoin(same)  # one row


_TOT = f"{r6('coalesce(sum(u) / nullif(sum(weight), 0), 0.5)', 'ts_auc')}, sum(weight)::bigint as pair_weight, count(case when weight > 0 then 1 end) as eligible_ages"
_ANEW = (
    "(select s.id, s.t, s.target, s.candidate, f.fold from scores s join (select id, ((row_number() over (partition by stratum"
    f" order by sha256('{_SALT}' || id::varchar), id) - 1) % 5)::int as fold from manifest) f using (id))"
)
register(
    "rescore_new_folds",
    lambda s, d: six(rescored(s, d), ["fold", "pair_weight", "eligible_ages", "changed"], ["ts_auc"]),
    f"select -1 as fold, {_TOT}, 0 as changed from terms union all select fold, {_TOT}, 0 as changed from ({auc_terms(_ANEW, 'candidate', 'fold')}) group by fold",
)
register(
    "joined_once",
    lambda s, d: audits.one_to_one(score_frame(s, d).select("id", "t", "candidate"), from_lineitem(s, d).filter("period = 2").select("id", "t", "target"), ["id", "t"]),
    "select s.id, s.t, s.candidate, x.target from scores s join (select id, t, target from series where period = 2) x using (id, t)",
)
register(
    "expected_score",
    lambda s, d: six(
        scoring.ts_auc(scoring.expected(score_frame(s, d), from_lineitem(s, d).filter("period = 2").select("id", "t"), "candidate"), "candidate"),
        ["pair_weight", "eligible_ages"],
        ["ts_auc"],
    ),
    f"select {_TOT} from terms",
)

# The bootstrap on multiplicities that SQL can state too


def _given(s: SparkSession, d: str, replicates: int = 5) -> DataFrame:
    times = lambda b: F.lpad(F.hex((F.col("id") * 7 + b * 3) % 4), 2, "0")
    w = decisions.manifest(from_lineitem(s, d)).select("id", F.unhex(F.concat(*[times(b) for b in range(replicates)])).alias("w"))
    g = decisions.bootstrap_terms(score_frame(s, d), w, replicates, ("candidate", "reference"))
    return g.select("replicate", F.coalesce(F.try_divide(F.col("u_candidate") - F.col("u_reference"), "z"), F.lit(0.0)).alias("delta"))


def _given_sql(score: str) -> str:
    counted = f"select t, b, {score} as s, sum(((id * 7 + b * 3) % 4) * target) as pos, sum(((id * 7 + b * 3) % 4) * (1 - target)) as neg from scores, (select unnest(range(5)) as b) group by all"
    below = "coalesce(sum(neg) over (partition by t, b order by s rows between unbounded preceding and 1 preceding), 0)"
    return f"(select b, sum(u) as u, sum(p * n) as z from (select t, b, sum(pos * (f + neg / 2)) as u, sum(pos) as p, sum(neg) as n from (select *, {below} as f from ({counted})) group by t, b) group by b)"


register(
    "bootstrap_given_counts",
    lambda s, d: six(_given(s, d), ["replicate"], ["delta"]),
    f"select x.b as replicate, {r6('coalesce((x.u - y.u) / nullif(x.z, 0), 0.0)', 'delta')} from {_given_sql('candidate')} x join {_given_sql('reference')} y using (b)",
)

# Models

_CHILDREN = ["E09", "E10", "E11", "E12"]


def nested(s: SparkSession, d: str) -> DataFrame:
    """The base model embedded in its children predicts the same."""
    f = _frame(s, d, "children")
    return audits.nesting(f, models.fit(f, "E08"), _CHILDREN)


register("embedding_audit", nested, " union all ".join(f"select '{c}' as child, 'E08' as parent, count(*) as rows, 0 as differing from base" for c in _CHILDREN))

_ROOTS = {"x1": 2**0.5, "x2": 6**0.5, "x3": 12**0.5}


def _inputs(s: SparkSession, d: str) -> DataFrame:
    """What E10 and E11 add to the base blocks, and the contexts q and a of E09 and E12, before any fit."""
    f = models.with_context(blocks.features(from_lineitem(s, d), "base"))
    cols: dict[str, Column] = {n: F.expr(sql) for n, sql in models.EXTRAS["E10"].items()}
    return f.withColumns(cols | {"x": F.expr(models.EXTRAS["E11"]["x"])})


register(
    "model_inputs",
    lambda s, d: six(_inputs(s, d), ["id", "t"], ["q", "a", "x1", "x2", "x3", "x"]),
    f"select id, t, {r6('coalesce(greatest(0.0, least(1.0, 1 - mse_ratio)), 0.0)', 'q')}, {r6('ln(t + 2.0::double)', 'a')},"
    f" {r6(f'(blk_i1 - blk_i2) / {_ROOTS["x1"]!r}::double', 'x1')}, {r6(f'(blk_i1 + blk_i2 - 2 * blk_i3) / {_ROOTS["x2"]!r}::double', 'x2')},"
    f" {r6(f'(blk_i1 + blk_i2 + blk_i3 - 3 * blk_i4) / {_ROOTS["x3"]!r}::double', 'x3')}, {r6(f'(blk_p_energy - blk_p_location) / {_ROOTS["x1"]!r}::double', 'x')} from base",
)

# Streams of blocks and of a model


def _streamed(s: SparkSession, d: str, made) -> tuple[DataFrame, DataFrame]:
    """Frame, and the rows of made(stream, refs) over its online points in four micro-batches, with a stop and a restart after two."""
    x, root = from_lineitem(s, d), shared_folder(s)
    streams.references(x).write.parquet(f"{root}/references")
    refs = s.read.parquet(f"{root}/references")
    points = streams.last_points(x)
    points.write.partitionBy("part").parquet(f"{root}/points")
    files = 0  # of a micro-batch
    for k in range(1, 5):
        s.read.parquet(f"{root}/points/part={k}").coalesce(2 * s.sparkContext.defaultParallelism).write.mode("append").parquet(f"{root}/in")
        files = files or len(s.read.parquet(f"{root}/in").inputFiles())
    schema = points.drop("part").schema
    for batches in (2, None):
        streams.replay(s, f"{root}/in", schema, lambda p: made(p, refs), f"{root}/out", f"{root}/state", files, batches)
    return x, s.read.parquet(f"{root}/out")


_STREAM = ["blk_r", "blk_i", "blk_p", "blk_d", "c_s"]
register(
    "stream_blocks",
    lambda s, d: six(_streamed(s, d, streams.score)[1].filter("not late"), ["id", "t"], _STREAM),
    f"select id, t, {', '.join(r6(c) for c in _STREAM[:4])}, {r6('(blk_js - blk_i) / sqrt(2.0::double)', 'c_s')} from jall",
)


def stream_model(s: SparkSession, d: str) -> DataFrame:
    """E14 over the stream and over the batch: rows, and how many predictions differ by more than 1e-9."""
    f = _frame(s, d, "E14")
    model = models.fit(f, "E14")
    _, out = _streamed(s, d, lambda p, refs: streams.infer(p, refs, model))
    batch = models.predict(f, model).select("id", "t", F.col("prediction").alias("batch"))
    j = out.join(batch, ["id", "t"], "full")
    far = F.col("prediction").isNull() | F.col("batch").isNull() | (F.abs(F.col("prediction") - F.col("batch")) > 1e-9)
    return j.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(far, 1)).alias("differing"))


register("stream_E14", stream_model, "select count(*) as rows, 0 as differing from base")


def attached(s: SparkSession, d: str) -> DataFrame:
    """A join of tables attached as read-only views."""
    audits.attach(s, d, ["nation", "region"], "attached_")
    return s.sql("select r_name, count(*) as nations from attached_nation join attached_region on n_regionkey = r_regionkey group by r_name")


register("attached_views", attached, "select r_name, count(*) as nations from nation join region on n_regionkey = r_regionkey group by r_name")
