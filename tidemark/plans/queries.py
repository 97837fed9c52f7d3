"""Every operator as a query over the driver's tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batch, blocks, decisions, detectors, integrity, models, profile, scoring
from ..sources import artifacts
from ..sources.series import from_events, from_lineitem, table
from ..streaming import scorer
from .sql import P, auc_terms, query, r6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql:
        ORACLE_SQL[name] = query(sql)


def six(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, and values to six decimals without negative zero."""
    return df.select(*keys, *[(F.round(F.col(v), 6) + 0.0).alias(v) for v in values])


def sql_six(source: str, keys: str, values: list[str], where: str = "") -> str:
    return f"select {keys}, {', '.join(r6(v) for v in values)} from {source} {where}"


def shared_folder(spark: SparkSession) -> str:
    return f"{artifacts.shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"


# Sources and checks

register("series_lineitem", lambda s, d: from_lineitem(s, d).select("id", "k", "value", "period", "t", "tau_index", "target"), "select id, k, value, period, t, tau_index, target from series")
register("series_events", lambda s, d: from_events(s, d).select("id", "k", "value", "period", "t"), "select id, k, value, period, t from eseries")
register(
    "keyed_read",
    lambda s, d: from_lineitem(s, d).filter("id = 5 and period = 1").select("id", "k", "value"),
    "select id, k, value from series where id = 5 and period = 1",
)
register(
    "row_numbers",
    lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select(F.col("_metadata.row_index").alias("i")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("i").alias("numbers"), F.max("i").alias("last")),
    "select count(*) as rows, count(*) as numbers, count(*) - 1 as last from lineitem",
)


def _triple(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observations, labels and an index with faults of every kind, from line items and orders."""
    li = table(s, d, "lineitem")
    x = li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("time"), F.when(F.col("l_linestatus") == "O", 2).when(F.col("l_quantity") > 49, 3).otherwise(1).alias("period"))
    y = li.filter("l_quantity > 10").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") + F.when(F.col("l_quantity") > 48, 7).otherwise(0)).alias("time"), F.when(F.col("l_quantity") > 45, 2).otherwise(1).alias("target"))
    o = table(s, d, "orders")
    index = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50 - 3).alias("tau_index"))
    return x, y, index


_X = "(select l_orderkey as id, l_linenumber as time, case when l_linestatus = 'O' then 2 when l_quantity > 49 then 3 else 1 end as period from lineitem)"
_Y = "(select l_orderkey as id, l_linenumber + case when l_quantity > 48 then 7 else 0 end as time, case when l_quantity > 45 then 2 else 1 end as target from lineitem where l_quantity > 10)"
_I = "(select o_orderkey as id, o_custkey % 50 - 3 as tau_index from orders)"
register(
    "integrity_checks",
    lambda s, d: integrity.checks(*_triple(s, d)),
    f"""select 'twice_x' as "check", count(*) as failures from (select id, time from {_X} group by all having count(*) > 1)
    union all select 'twice_y', count(*) from (select id, time from {_Y} group by all having count(*) > 1)
    union all select 'twice_index', count(*) from (select id from {_I} group by all having count(*) > 1)
    union all select 'bad_x', count(*) from {_X} where id is null or time is null or period is null or period not in (1, 2)
    union all select 'bad_y', count(*) from {_Y} where id is null or time is null or target is null or target not in (0, 1)
    union all select 'bad_index', count(*) from {_I} where id is null or tau_index is null or tau_index < -1 or tau_index <> floor(tau_index)
    union all select 'y_without_x', count(*) from {_Y} a where not exists (select 1 from {_X} b where a.id = b.id and a.time = b.time)
    union all select 'x_without_y', count(*) from {_X} a where period = 2 and not exists (select 1 from {_Y} b where a.id = b.id and a.time = b.time)
    union all select 'x_without_index', count(*) from {_X} a where not exists (select 1 from {_I} b where a.id = b.id)
    union all select 'index_without_x', count(*) from {_I} a where not exists (select 1 from {_X} b where a.id = b.id)""",
)
register("duplicate_keys", lambda s, d: integrity.duplicates(table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("time")), "id", "time"), "select l_orderkey as id, l_linenumber as time, count(*) as rows from lineitem group by all having count(*) > 1")
register(
    "labels_attached",
    lambda s, d: _triple(s, d)[0].distinct().join(_triple(s, d)[1].distinct(), ["id", "time"], "left").groupBy("period", "target").agg(F.count(F.lit(1)).alias("rows")),
    f"select period, target, count(*) as rows from (select distinct * from {_X}) left join (select distinct * from {_Y}) using (id, time) group by period, target",
)


def _changed(df: DataFrame) -> DataFrame:
    k = F.col("k")
    return df.filter(k % 89 != 0).withColumn("value", F.when(k % 101 == 0, None).when(k % 97 == 0, F.col("value") + 1).otherwise(F.col("value")))


register(
    "artifact_difference",
    lambda s, d: integrity.difference(_changed(from_lineitem(s, d)), from_lineitem(s, d).filter("k % 83 <> 0"), ["id", "k"], ["value"]),
    """select coalesce(a.id, b.id) as id, coalesce(a.k, b.k) as k, a.value as value_left, b.value as value_right,
    case when b.id is null then 'left' when a.id is null then 'right' else 'both' end as side
    from (select id, k, case when k % 101 = 0 then null when k % 97 = 0 then value + 1 else value end as value from series where k % 89 <> 0) a
    full join (select id, k, value from series where k % 83 <> 0) b on a.id = b.id and a.k = b.k
    where a.value is distinct from b.value or a.id is null or b.id is null""",
)


def score_frame(s: SparkSession, d: str) -> DataFrame:
    """Online rows with two scores to six decimals, fold and stratum."""
    x = from_lineitem(s, d)
    r = detectors.detect(x, "squared", "cusum").select("id", "t", "target", "tau_index", (F.round("squared", 6) + 0.0).alias("candidate"), (F.round("cusum", 6) + 0.0).alias("reference"))
    return r.join(decisions.manifest(x).select("id", "fold", "stratum"), "id")


register(
    "prediction_coverage",
    lambda s, d: integrity.coverage(score_frame(s, d).filter("t % 50 <> 7").select("id", "t", F.when(F.col("t") % 31 == 0, 1 - F.col("target")).otherwise(F.col("target")).alias("target"), F.when(F.col("t") % 37 == 0, 9).otherwise(F.col("fold")).alias("fold"), (F.col("candidate") * 1.3).alias("prediction")), from_lineitem(s, d).filter("period = 2"), decisions.manifest(from_lineitem(s, d))),
    """select count(*) as rows, count(case when e.id is null then 1 end) as unexpected, count(case when p.target is null then 1 end) as missing,
    count(case when p.target is distinct from e.target and p.id is not null then 1 end) as wrong_target, count(case when p.id is not null and p.fold is distinct from m.fold then 1 end) as wrong_fold,
    count(case when p.id is not null and (p.prediction is null or not isfinite(p.prediction) or p.prediction < 0 or p.prediction > 1) then 1 end) as bad_prediction
    from (select id, t, case when t % 31 = 0 then 1 - target else target end as target, case when t % 37 = 0 then 9 else fold end as fold, candidate * 1.3::double as prediction from scores where t % 50 <> 7) p
    full join (select id, t, target from series where period = 2) e using (id, t) left join manifest m using (id)""",
)
register("frame_violations", lambda s, d: scoring.violations(score_frame(s, d).withColumn("p", F.when(F.col("t") == 3, F.col("candidate") + 1).otherwise(F.col("candidate"))), "p"), "select 0 as null_keys, 0 as bad_ages, 0 as bad_targets, 0 as nonfinite, count(case when t = 3 and candidate + 1 > 1 then 1 end) as outside_unit, 0 as duplicate_keys from scores")
register(
    "label_alignment",
    lambda s, d: integrity.label_alignment(from_lineitem(s, d)).drop("tau_index"),
    """select id, max(falls) as falls, first_positive, online, match_before, match_same, match_after, "offset", phase from (
    select id, max(f) as falls, min(case when target = 1 then t end) as first_positive, count(*) as online,
      min((target = (tau_index >= 0 and t >= tau_index - 1)::int)::int) as match_before, min((target = (tau_index >= 0 and t >= tau_index)::int)::int) as match_same, min((target = (tau_index >= 0 and t >= tau_index + 1)::int)::int) as match_after,
      case when max(tau_index) >= 0 then min(case when target = 1 then t end) - max(tau_index) end as "offset",
      case when 3 * (min(case when target = 1 then t end) + 1) <= count(*) then 'early' when 3 * (min(case when target = 1 then t end) + 1) <= 2 * count(*) then 'middle' when min(case when target = 1 then t end) is not null then 'late' end as phase
    from (select *, coalesce((lag(target) over (partition by id order by t) > target)::int, 0) as f from series where period = 2) group by id) group by all""",
)

# Detectors

for _n in ("ewma", "cusum", "page_hinkley", "running_mean", "variance_ratio", "absolute", "squared"):
    register(f"detector_{_n}", lambda s, d, n=_n: six(detectors.detect(from_lineitem(s, d), n), ["id", "t"], [n]).withColumnRenamed(n, "score"), f"select id, t, {r6('score')} from d_{_n}")
register("detectors_events", lambda s, d: six(detectors.detect(from_events(s, d), "ewma", "cusum", "squared"), ["id", "t"], ["ewma", "cusum", "squared"]), f"select id, t, {r6('a.score', 'ewma')}, {r6('b.score', 'cusum')}, {r6('c.score', 'squared')} from x_ewma a join x_cusum b using (id, t) join x_squared c using (id, t)")
_CONTROLS = ("constant", "age_only", "perfect", "reversed")


def control_scores(s: SparkSession, d: str) -> DataFrame:
    x = detectors.detect(from_lineitem(s, d), *_CONTROLS)
    long = x.select("id", "t", "target", F.explode(F.create_map(*[c for n in _CONTROLS for c in (F.lit(n), F.col(n))])).alias("control", "prediction"))
    return scoring.ts_auc(long, "prediction", ("control",)).select("control", (F.round("ts_auc", 6) + 0.0).alias("ts_auc"), "pair_weight", "eligible_ages")


register("controls", control_scores, " union all ".join(f"select '{c}' as control, {r6('coalesce(sum(u) / nullif(sum(weight), 0), 0.5)', 'ts_auc')}, sum(weight)::bigint as pair_weight, count(case when weight > 0 then 1 end) as eligible_ages from ({auc_terms(f'd_{c}', 'score')})" for c in _CONTROLS))


def detector_scores(s: SparkSession, d: str) -> DataFrame:
    """TS-AUC of all seven detectors from one pass."""
    names = scorer.SCORES
    x = detectors.detect(from_lineitem(s, d), *names)
    long = x.select("id", "t", "target", F.explode(F.create_map(*[c for n in names for c in (F.lit(n), F.round(F.col(n), 6) + 0.0)])).alias("detector", "prediction"))
    return scoring.ts_auc(long, "prediction", ("detector",)).select("detector", (F.round("ts_auc", 6) + 0.0).alias("ts_auc"), "pair_weight", "eligible_ages")


register("detector_scores", detector_scores, " union all ".join(f"select '{c}' as detector, {r6('coalesce(sum(u) / nullif(sum(weight), 0), 0.5)', 'ts_auc')}, sum(weight)::bigint as pair_weight, count(case when weight > 0 then 1 end) as eligible_ages from ({auc_terms(f'(select *, round(score, 6) + 0.0 as sc from d_{c})', 'sc')})" for c in scorer.SCORES))

# Blocks

register("block_raw_full_history", lambda s, d: six(blocks.features(from_lineitem(s, d), only=("rh",)), ["id", "t"], ["blk_r1", "blk_r2", "blk_r3", "blk_r4", "blk_r"]), sql_six("rawh", "id, t", ["blk_r1", "blk_r2", "blk_r3", "blk_r4", "blk_r"], "where period = 2"))
register("block_raw", lambda s, d: six(blocks.features(from_lineitem(s, d), only=("r",)), ["id", "t"], ["blk_r1", "blk_r2", "blk_r3", "blk_r4", "blk_r"]), sql_six("raw", "id, t", ["blk_r1", "blk_r2", "blk_r3", "blk_r4", "blk_r"], "where period = 2"))
_AR = lambda s, d: blocks.autoregression(from_lineitem(s, d))
register("ar_coefficients", lambda s, d: six(_AR(s, d).groupBy("id").agg(F.first("ar_mu").alias("ar_mu"), F.first("ar_sd").alias("ar_sd"), *[F.first(f"beta{i}").alias(f"b{i}") for i in range(6)]), ["id"], ["ar_mu", "ar_sd", *[f"b{i}" for i in range(6)]]), "select id, " + ", ".join(r6(f"any_value({c})", c) for c in ("ar_mu", "ar_sd", *[f"b{i}" for i in range(6)])) + " from ar group by id")
register("ar_innovations", lambda s, d: six(_AR(s, d).filter("period = 2"), ["id", "t"], ["az", "e"]), sql_six("ar", "id, t", ["az", "e"], "where period = 2"))
_INN = lambda s, d: blocks.innovation(_AR(s, d))
register("block_innovation", lambda s, d: six(blocks.features(from_lineitem(s, d), only=("i",)), ["id", "t"], ["r", "blk_i1", "blk_i2", "blk_i3", "blk_i4", "blk_i"]), sql_six("inn", "id, t", ["r", "blk_i1", "blk_i2", "blk_i3", "blk_i4", "blk_i"], "where period = 2"))
register("ar_mse_ratio", lambda s, d: six(_INN(s, d).groupBy("id").agg(F.first("mse_ratio").alias("mse_ratio")), ["id"], ["mse_ratio"]), f"select id, {r6('any_value(mse_ratio)', 'mse_ratio')} from inn group by id")
register("block_rank", lambda s, d: six(blocks.features(from_lineitem(s, d), only=("p",)), ["id", "t"], ["blk_p_location", "blk_p_energy", "blk_p"]), sql_six("rnk", "id, t", ["blk_p_location", "blk_p_energy", "blk_p"], "where period = 2"))
register("midrank_cdf", lambda s, d: six(blocks.midrank(_INN(s, d), "r", blocks.ref_rows(), "u"), ["id", "k"], ["u"]).filter("k >= 5"), "select id, k, " + r6("blk_p_u", "u") + " from rnk_u where k >= 5")
register("block_sign_dependence", lambda s, d: six(blocks.features(from_lineitem(s, d), only=("d",)), ["id", "t"], ["blk_d128", "blk_d256", "blk_d"]), f"select id, t, {r6('blk_d128')}, {r6('blk_d256')}, {r6('(blk_d128 + blk_d256) / 2', 'blk_d')} from sgn")
for _e, _mean in {"E03": "blk_r", "E04": "blk_i", "E05": "(blk_r + blk_i) / 2", "E06": "(blk_r + blk_i + blk_p) / 3", "E07": "(blk_r + blk_i + blk_p + blk_d) / 4"}.items():
    register(f"experiment_{_e}", lambda s, d, e=_e: six(blocks.experiment(from_lineitem(s, d), e), ["id", "t"], ["prediction"]), f"select id, t, {r6(_mean, 'prediction')} from base")
register("experiment_E02", lambda s, d: six(blocks.experiment(from_lineitem(s, d), "E02"), ["id", "t"], ["prediction"]), f"select id, t, {r6('blk_r', 'prediction')} from rawh where period = 2")
for _k, _name in (("s", "slow"), ("f", "fast"), ("r", "robust")):
    register(f"block_scale_{_name}", lambda s, d, k=_k: six(blocks.features(from_lineitem(s, d), only=(f"j{k}",)), ["id", "t"], [f"v_{k}", f"u_{k}", f"a_{k}", f"blk_j{k}"]), sql_six(f"sc{_k}", "id, t", [f"v_{_k}", f"u_{_k}", f"a_{_k}", f"blk_j{_k}"], "where period = 2"))
register("block_scale_rank", lambda s, d: six(blocks.features(from_lineitem(s, d), only=("ps",)), ["id", "t"], ["blk_ps_location", "blk_ps_energy", "blk_ps"]), sql_six("rks", "id, t", ["blk_ps_location", "blk_ps_energy", "blk_ps"], "where period = 2"))
register("contrasts", lambda s, d: six(blocks.features(from_lineitem(s, d), only=("i", "p", "js", "jf", "jr", "ps")), ["id", "t"], ["c_s", "c_f", "c_r", "k_s"]), f"select id, t, {r6('(blk_js - blk_i) / sqrt(2.0::double)', 'c_s')}, {r6('(blk_jf - blk_i) / sqrt(2.0::double)', 'c_f')}, {r6('(blk_jr - blk_i) / sqrt(2.0::double)', 'c_r')}, {r6('(blk_ps - blk_p) / sqrt(2.0::double)', 'k_s')} from jall")
_NZ = lambda s, d: blocks.normal_scores(blocks.scales(_INN(s, d), ["s"]))
register("normal_scores", lambda s, d: six(_NZ(s, d).filter("k >= 5"), ["id", "k"], ["nz", "nz_mu", "nz_v0"]), sql_six("nz", "id, k", ["nz", "nz_mu", "nz_v0"], "where k >= 5"))
register("moment_blocks", lambda s, d: six(blocks.features(from_lineitem(s, d), only=("m",)), ["id", "t"], list(blocks.MOMENTS)), f"select id, k - h as t, {', '.join(r6(m) for m in blocks.MOMENTS)} from " + " join ".join([f"mom_{m}" + (" using (id, k)" if i else "") for i, m in enumerate(blocks.MOMENTS)]) + " join (select id, k, h from nz where period = 2) using (id, k)")
_LIK = lambda s, d: blocks.features(from_lineitem(s, d), only=("l",))
register("likelihood_blocks", lambda s, d: six(_LIK(s, d), ["id", "t"], ["l_plus", "l_minus", "c_plus", "c_minus"]), sql_six("lik", "id, t", ["l_plus", "l_minus", "c_plus", "c_minus"]))
register("trajectory", lambda s, d: six(_LIK(s, d), ["id", "t"], ["drawdown", "trajectory_ewma"]), sql_six("traj", "id, t", ["drawdown", "trajectory_ewma"]))
register("long_run_factor", lambda s, d: six(blocks.long_run_factor(_NZ(s, d)).groupBy("id").agg(F.first("hac_eta").alias("hac_eta")), ["id"], ["hac_eta"]), f"select id, {r6('hac_eta')} from hac")
register("omnibus", lambda s, d: six(_LIK(s, d).withColumns({"l_max": F.greatest("l_plus", "l_minus"), "c_max": F.greatest("c_plus", "c_minus")}), ["id", "t"], ["l_max", "c_max"]), f"select id, t, {r6('greatest(l_plus, l_minus)', 'l_max')}, {r6('greatest(c_plus, c_minus)', 'c_max')} from lik")
register(
    "endpoint_counts",
    lambda s, d: blocks.midrank(blocks.scales(_INN(s, d), ["s"]), "u_s", blocks.ref_rows(), "p").withColumns({"lo": blocks.over_history(F.min, blocks.ref_rows(), F.col("u_s")), "hi": blocks.over_history(F.max, blocks.ref_rows(), F.col("u_s"))}).filter("period = 2").groupBy("id").agg(F.count(F.when(F.col("u_s") < F.col("lo"), 1)).alias("below"), F.count(F.when(F.col("u_s") > F.col("hi"), 1)).alias("above"), F.count(F.lit(1)).alias("rows")),
    f"select id, count(case when period = 2 and u_s < lo then 1 end) as below, count(case when period = 2 and u_s > hi then 1 end) as above, count(case when period = 2 then 1 end) as rows from (select *, min(case when period = 1 and k >= cut then u_s end) over ({P}) as lo, max(case when period = 1 and k >= cut then u_s end) over ({P}) as hi from scs) group by id",
)

_ALL = ["blk_r", "blk_i", "blk_p", "blk_d", "blk_js", "blk_jf", "blk_jr", "blk_ps", *blocks.MOMENTS, "l_plus", "l_minus", "c_plus", "c_minus"]
register("feature_frame", lambda s, d: six(blocks.features(from_lineitem(s, d), "normal"), ["id", "t"], _ALL), f"select jall.id, jall.t, {', '.join(r6(c) for c in _ALL)} from jall " + " ".join(f"join mom_{m} using (id, k)" for m in blocks.MOMENTS) + " join lik using (id, k)")

# Scores

_terms = lambda s, d: scoring.pair_terms(score_frame(s, d), "candidate")
register("per_age", lambda s, d: six(scoring.per_age(score_frame(s, d), "candidate"), ["t", "age", "active", "positive", "negative", "weight"], ["auc", "weight_fraction"]), f"select t, t + 1 as age, active, positive, negative, weight, {r6('u / nullif(weight, 0)', 'auc')}, {r6('weight / sum(weight) over ()::double', 'weight_fraction')} from terms")
_TOT = f"{r6('coalesce(sum(u) / nullif(sum(weight), 0), 0.5)', 'ts_auc')}, sum(weight)::bigint as pair_weight, count(case when weight > 0 then 1 end) as eligible_ages"
register("ts_auc", lambda s, d: six(scoring.ts_auc(score_frame(s, d), "candidate"), ["pair_weight", "eligible_ages"], ["ts_auc"]), f"select {_TOT} from terms")
_BUCKET = "case " + " ".join(f"when t + 1 >= {lo}" + (f" and t + 1 <= {hi} then '{lo}-{hi}'" if hi else f" then '{lo}+'") for lo, hi in scoring.BUCKETS) + " end"
register("age_buckets", lambda s, d: six(scoring.buckets(_terms(s, d)), ["age_range", "pair_weight", "eligible_ages", "positive_rows", "negative_rows"], ["weight_fraction", "ts_auc"]), f"select {_BUCKET} as age_range, sum(weight)::bigint as pair_weight, count(case when weight > 0 then 1 end) as eligible_ages, sum(positive)::bigint as positive_rows, sum(negative)::bigint as negative_rows, {r6('sum(weight) / (select sum(weight) from terms)::double', 'weight_fraction')}, {r6('sum(u) / nullif(sum(weight), 0)', 'ts_auc')} from terms group by 1")
register("combined_ages", lambda s, d: six(scoring.combined(_terms(s, d)), ["ages", "pair_weight", "eligible_ages", "positive_rows", "negative_rows"], ["ts_auc"]), " union all ".join(f"select '{n}' as ages, sum(weight)::bigint as pair_weight, count(case when weight > 0 then 1 end) as eligible_ages, sum(positive)::bigint as positive_rows, sum(negative)::bigint as negative_rows, {r6('sum(u) / nullif(sum(weight), 0)', 'ts_auc')} from terms where {c} having count(*) > 0" for n, c in (("le64", "t + 1 <= 64"), ("ge129", "t + 1 >= 129"), ("ge257", "t + 1 >= 257"))))
register("folds_scored", lambda s, d: six(scoring.pooled_and_folds(score_frame(s, d), "candidate"), ["fold", "pair_weight", "eligible_ages"], ["ts_auc"]), f"select -1 as fold, {_TOT} from terms union all select fold, {_TOT} from ({auc_terms('scores', 'candidate', 'fold')}) group by fold")
register("fold_deltas", lambda s, d: six(scoring.difference(scoring.pooled_and_folds(score_frame(s, d), "candidate"), scoring.pooled_and_folds(score_frame(s, d), "reference"), "fold"), ["fold"], ["candidate", "reference", "delta"]), " union all ".join(f"select {f} as fold, {r6('a.v', 'candidate')}, {r6('b.v', 'reference')}, {r6('a.v - b.v', 'delta')} from (select {k} as f, coalesce(sum(u) / nullif(sum(weight), 0), 0.5) as v from ({x}) {g}) a join (select {k} as f, coalesce(sum(u) / nullif(sum(weight), 0), 0.5) as v from ({y}) {g}) b using (f)" for f, k, g, x, y in (("-1", "-1", "", "select * from terms", "select * from rterms"), ("f", "fold", "group by fold", auc_terms("scores", "candidate", "fold"), auc_terms("scores", "reference", "fold")))))
register("training_weights", lambda s, d: scoring.training_weights(score_frame(s, d)).select("id", "t", "target", F.round(F.col("omega") * 1e6, 6).alias("omega_ppm")), "select s.id, s.t, s.target, round(1e6 * (tm.weight / (2 * (select sum(weight) from terms)::double * case when s.target = 1 then positive else negative end)), 6) as omega_ppm from scores s join terms tm using (t) where weight > 0")
register("weight_audit", lambda s, d: six(scoring.weight_audit(score_frame(s, d)), ["t", "n_pos", "n_neg", "pair_weight"], ["expected_mass", "mass", "positive_mass", "negative_mass"]), "select t, positive as n_pos, negative as n_neg, weight as pair_weight, " + ", ".join(r6(f"weight / (select sum(weight) from terms)::double / {h}", n) for n, h in (("expected_mass", 1), ("mass", 1), ("positive_mass", 2), ("negative_mass", 2))) + " from terms where weight > 0")
register("weighted_moments", lambda s, d: six(scoring.weighted_moments(scoring.training_weights(score_frame(s, d)).withColumn("flat", F.lit(0.3)), ["candidate", "reference", "flat"]), ["column"], ["mean", "std"]), " union all ".join(f"""select '{c}' as "column", {r6('m', 'mean')}, {r6('sqrt(greatest(sum(om * pow(x - m, 2)) / sum(om), 0))', 'std')} from (select *, sum(om * x) over () / sum(om) over () as m from (select {x} as x, tm.weight / (2 * (select sum(weight) from terms)::double * case when s.target = 1 then positive else negative end) as om from scores s join terms tm using (t) where weight > 0)) group by m""" for c, x in (("candidate", "candidate"), ("reference", "reference"))) + """ union all select 'flat' as "column", 0.3::double as mean, 0.0::double as std""")
register("ties", lambda s, d: six(scoring.ties(score_frame(s, d).withColumn("p", F.floor(F.col("candidate") * 64)), "p"), ["tied_pairs", "class_ties", "all_pairs"], ["rate"]), f"select a.tied_pairs, a.class_ties, b.all_pairs, {r6('a.tied_pairs / b.all_pairs', 'rate')} from (select sum(c * (c - 1) / 2)::bigint as tied_pairs, sum(p * (c - p))::bigint as class_ties from (select t, floor(candidate * 64), count(*) as c, sum(target) as p from scores group by all)) a, (select sum(c * (c - 1) / 2)::bigint as all_pairs from (select t, count(*) as c from scores group by t)) b")
register("stuck_scores", lambda s, d: scoring.stuck(score_frame(s, d).withColumn("p", F.ceil(F.col("candidate") * 64) / 64), "p"), "select sum(coalesce((p = b)::int, 0))::bigint as adjacent_ties, sum((p = 1)::int)::bigint as saturated, count(*) as rows from (select ceil(candidate * 64) / 64 as p, lag(ceil(candidate * 64) / 64) over (partition by id order by t) as b from scores)")
register("saturation", lambda s, d: six(scoring.saturation(score_frame(s, d), ["candidate", "reference"]), ["column"], ["at_zero", "at_one", "ge_099"]), " union all ".join(f"""select '{c}' as "column", {r6(f'avg(({c} = 0)::int)', 'at_zero')}, {r6(f'avg(({c} = 1)::int)', 'at_one')}, {r6(f'avg(({c} >= 0.99)::int)', 'ge_099')} from scores""" for c in ("candidate", "reference")))
_W = "(select s.*, tm.weight / (select sum(weight) from terms)::double / tm.active as rw, candidate - avg(candidate) over (partition by t) as cc, reference - avg(reference) over (partition by t) as rc from scores s join terms tm using (t))"
_wc = lambda x, y: f"(sum(rw * {x} * {y}) - sum(rw * {x}) * sum(rw * {y}) / sum(rw)) / sqrt((sum(rw * {x} * {x}) - sum(rw * {x}) * sum(rw * {x}) / sum(rw)) * (sum(rw * {y} * {y}) - sum(rw * {y}) * sum(rw * {y}) / sum(rw)))"
register("weighted_correlations", lambda s, d: six(scoring.correlations(score_frame(s, d), ["candidate"], ["reference"]), ["feature", "against", "near"], ["raw_weighted", "age_centered"]), f"select 'candidate' as feature, 'reference' as against, abs({_wc('cc', 'rc')}) >= 0.98 as near, {r6(_wc('candidate', 'reference'), 'raw_weighted')}, {r6(_wc('cc', 'rc'), 'age_centered')} from {_W}")
register("weight_milestones", lambda s, d: scoring.milestones(_terms(s, d)), "select share::double as share, min(t) + 1 as age from (select t, sum(weight) over (order by t) / sum(weight) over ()::double as c from terms), (select unnest([0.25, 0.5, 0.75, 0.9, 0.95]) as share) where c >= share group by share")
register("subset_scores", lambda s, d: six(scoring.ts_auc(blocks.features(from_lineitem(s, d), only=("i",)).withColumn("subset", F.when(F.col("mse_ratio") < 0.9, "lt_0.9").when(F.col("mse_ratio") <= 1, "0.9_to_1.0").when(F.col("mse_ratio") > 1, "gt_1.0").otherwise("unsupported")).withColumn("p", F.round("blk_i", 6)), "p", ("subset",)), ["subset", "pair_weight", "eligible_ages"], ["ts_auc"]), f"select subset, {_TOT} from ({auc_terms('''(select *, case when mse_ratio < 0.9 then 'lt_0.9' when mse_ratio <= 1 then '0.9_to_1.0' when mse_ratio > 1 then 'gt_1.0' else 'unsupported' end as subset, round(blk_i, 6) as p from base)''', 'p', 'subset')}) group by subset")
register("block_scores", lambda s, d: six(scoring.ts_auc(blocks.features(from_lineitem(s, d), "base").select("id", "t", "target", F.explode(F.create_map(*[x for b in ("blk_r", "blk_i", "blk_p", "blk_p_location", "blk_p_energy", "blk_d") for x in (F.lit(b), F.round(F.col(b), 6))])).alias("block", "p")), "p", ("block",)), ["block", "pair_weight", "eligible_ages"], ["ts_auc"]), " union all ".join(f"select '{b}' as block, {_TOT} from ({auc_terms(f'(select t, target, round({b}, 6) as p from base)', 'p')})" for b in ("blk_r", "blk_i", "blk_p", "blk_p_location", "blk_p_energy", "blk_d")))
_AB = ("energy_over_break", "energy_over_predictive", "predictive_over_break")
register("break_absorption", lambda s, d: six(scoring.absorption(blocks.features(from_lineitem(s, d), only=("js", "jf", "jr")).withColumn("e2", F.col("e") * F.col("e"))), ["kind", "bin", "series", "observations"], [f"{c}_{q}" for c in _AB for q in ("q25", "median", "q75")]), "select kind, bin, count(*) as series, sum(n)::bigint as observations, " + ", ".join(r6(f"quantile_cont({c}, {v})", f"{c}_{q}") for c in _AB for q, v in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))) + " from (select kind, bin, id, count(*) as n, avg(e2 / base_) as energy_over_break, avg(e2 / v) as energy_over_predictive, avg(v / base_) as predictive_over_break from (select id, kind, e2, v, first_value(v) over (partition by id, kind order by t) as base_, case when t - tau_index + 1 <= 32 then '1-32' when t - tau_index + 1 <= 128 then '33-128' when t - tau_index + 1 <= 256 then '129-256' else '257+' end as bin from (" + " union all ".join(f"select id, t, tau_index, e2, '{k}' as kind, v_{k} as v from jall where tau_index >= 0 and t >= tau_index" for k in "sfr") + ")) group by kind, bin, id) group by kind, bin")

# Folds, partitions, decisions

register("series_manifest", lambda s, d: decisions.manifest(from_lineitem(s, d)), "select * from manifest")
register("fold_balance", lambda s, d: decisions.fold_balance(decisions.manifest(from_lineitem(s, d))), "select stratum, " + ", ".join(f"count(case when fold = {k} then 1 end) as fold_{k}" for k in range(5)) + " from manifest group by stratum")
_CELL = "case stratum " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(decisions.STRATA)) + " end"
_PART = f"(select *, case when (row_number() over (order by {_CELL}, fold, sha256('{decisions.PARTITION_SALT}' || id::varchar), id::varchar) - 1) % 2 = 0 then 'A' else 'B' end as partition_ from manifest)"
register("partition_halves", lambda s, d: decisions.partition(decisions.manifest(from_lineitem(s, d))).select("id", "stratum", "fold", "partition"), f'select id, stratum, fold, partition_ as "partition" from {_PART}')
register("partition_scores", lambda s, d: six(scoring.ts_auc(decisions.in_partition(score_frame(s, d), decisions.partition(decisions.manifest(from_lineitem(s, d)))), "candidate", ("partition",)), ["partition", "pair_weight", "eligible_ages"], ["ts_auc"]), f'select partition_ as "partition", {_TOT} from ({auc_terms(f"(select s.*, p.partition_ from scores s join {_PART} p using (id))", "candidate", "partition_")}) group by partition_')
register("winner", lambda s, d: decisions.winner(detector_scores(s, d).select(F.col("detector").alias("experiment"), "ts_auc", F.length("detector").alias("inputs"), (F.col("ts_auc") > 0.3).alias("advances")), "none"), "select detector as experiment from (" + " union all ".join(f"select '{c}' as detector, round(sum(u) / sum(weight), 6) as v from ({auc_terms(f'(select *, round(score, 6) + 0.0 as sc from d_{c})', 'sc')})" for c in scorer.SCORES) + ") order by v desc, length(detector), detector limit 1")
register(
    "related_groups",
    lambda s, d: decisions.groups(table(s, d, "supplier").select(F.col("s_suppkey").alias("id")), table(s, d, "supplier").select(F.col("s_suppkey").alias("a"), "s_nationkey").join(table(s, d, "supplier").select(F.col("s_suppkey").alias("b"), "s_nationkey"), "s_nationkey").filter("b = a + 1 or b = a + 7").select("a", "b")),
    """with recursive e as (select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b using (s_nationkey) where abs(b.s_suppkey - a.s_suppkey) in (1, 7)),
    w(id, g) as (select s_suppkey, s_suppkey from supplier union select e.b, w.g from w join e on w.id = e.a) select id, min(g) as "group" from w group by id""",
)
ORACLE_SQL["related_groups"] = """with recursive e as (select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b using (s_nationkey) where abs(b.s_suppkey - a.s_suppkey) in (1, 7)),
    w(id, g) as (select s_suppkey, s_suppkey from supplier union select e.b, w.g from w join e on w.id = e.a) select id, min(g) as "group" from w group by id"""
register("paired_bootstrap", lambda s, d: decisions.paired_bootstrap(score_frame(s, d), decisions.manifest(from_lineitem(s, d)), "candidate", "reference"))

# Profiles

_STAT = ["mean", "std", "median", "mad", *profile.QUANTILES, "skewness", "excess_kurtosis", "extreme_fraction", "slope_per_tick", "slope_times_length_over_sd", "difference_sd"]
_PAST = lambda s, d: from_lineitem(s, d).filter("period = 1")
_STATS_SQL = f"""select id, length, nonfinite, constant, zero_mad, {', '.join(r6(c) for c in _STAT)} from (
    select id, count(*) as length, 0 as nonfinite, avg(value) as mean, stddev_samp(value) as std, max(med) as median, max(mad) as mad, (min(value) = max(value))::int as constant, (max(mad) = 0)::int as zero_mad,
    {', '.join(f'quantile_cont(value, {q}) as {n}' for n, q in profile.QUANTILES.items())},
    avg(pow(value - mu, 3)) / pow(avg(pow(value - mu, 2)), 1.5) as skewness, avg(pow(value - mu, 4)) / pow(avg(pow(value - mu, 2)), 2) - 3 as excess_kurtosis,
    avg((dev > 5 * 1.4826::double * mad)::int) as extreme_fraction, regr_slope(value, k) as slope_per_tick, regr_slope(value, k) * count(*) / stddev_samp(value) as slope_times_length_over_sd, stddev_samp(dx) as difference_sd
    from (select *, median(dev) over ({P}) as mad from (select *, abs(value - med) as dev from (select *, median(value) over ({P}) as med, avg(value) over ({P}) as mu, value - lag(value) over (partition by id order by k) as dx from series where period = 1))) group by id)"""
register("series_statistics", lambda s, d: six(profile.series_statistics(_PAST(s, d)).withColumn("difference_sd", F.sqrt("difference_variance")), ["id", "length", "nonfinite", "constant", "zero_mad"], _STAT), _STATS_SQL)
_ACF = [f"{n}_{g}" for n in profile.TRANSFORMS for g in profile.LAGS]
_TR = {"acf": "value", "abs_acf": "abs(value)", "squared_acf": "value * value", "centered_abs_acf": "abs(value - med)", "centered_squared_acf": "pow(value - mu, 2)"}
register("autocorrelations", lambda s, d: six(profile.autocorrelations(_PAST(s, d)), ["id"], _ACF), "select id, " + ", ".join(r6(f"corr({n}, {n}_{g})", f"{n}_{g}") for n in _TR for g in profile.LAGS) + " from (select *, " + ", ".join(f"lag({n}, {g}) over (partition by id order by k) as {n}_{g}" for n in _TR for g in profile.LAGS) + " from (select id, k, " + ", ".join(f"{x} as {n}" for n, x in _TR.items()) + f" from (select *, median(value) over ({P}) as med, avg(value) over ({P}) as mu from series where period = 1))) group by id")
register("distribution_table", lambda s, d: six(profile.distribution(from_lineitem(s, d), ["value", "k", "tau_index"]), ["statistic", "count", "valid", "nonfinite"], [*profile.TABLE, "mean"]), " union all ".join(f"""select '{c}' as statistic, count(*) as "count", count({c}) as valid, 0 as nonfinite, """ + ", ".join(r6(f"quantile_cont({c}::double, {q})", f'"{n}"') for n, q in profile.TABLE.items()) + f", {r6(f'avg({c})', 'mean')} from series" for c in ("value", "k", "tau_index")))
register("feature_quantiles", lambda s, d: blocks.features(from_lineitem(s, d), only=("i",)).select(F.explode(F.percentile("blk_i", F.array(*[F.lit(i / 20) for i in range(21)]))).alias("q")).select((F.round("q", 6) + 0.0).alias("q")), f"select {r6('q')} from (select unnest(quantile_cont(blk_i, [{', '.join(str(i / 20) for i in range(21))}])) as q from base)")
_SIG = ["mean_change", *[f"{q}_change" for q in profile.QUANTILES], "log_variance_ratio", "log_mad_ratio", "skewness_change", "excess_kurtosis_change", *[f"acf_{g}_change" for g in profile.LAGS], "tail_frequency_change"]


def _signature_sql(sides: str) -> str:
    stats = f"""select id, side, count(*) as len, avg(value) as mean, stddev_samp(value) as std, max(mad) as mad, {', '.join(f'quantile_cont(value, {q}) as {n}' for n, q in profile.QUANTILES.items())},
        case when count(*) >= 8 then avg(pow(value - mu, 3)) / pow(avg(pow(value - mu, 2)), 1.5) end as skewness, case when count(*) >= 8 then avg(pow(value - mu, 4)) / pow(avg(pow(value - mu, 2)), 2) - 3 end as excess_kurtosis,
        {', '.join(f'case when count(l{g}) >= 4 then corr(value, l{g}) end as acf_{g}' for g in profile.LAGS)}
        from (select *, median(abs(value - med)) over (partition by id, side) as mad, {', '.join(f'lag(value, {g}) over (partition by id, side order by k) as l{g}' for g in profile.LAGS)} from (select *, median(value) over (partition by id, side) as med, avg(value) over (partition by id, side) as mu from ({sides}))) group by id, side"""
    per = lambda c: f"(b.{c} - a.{c}) / a.std"
    cols = {"mean_change": per("mean"), **{f"{q}_change": per(q) for q in profile.QUANTILES}, "log_variance_ratio": "2 * ln(b.std / a.std)", "log_mad_ratio": "ln(b.mad / a.mad)", **{f"{c}_change": f"b.{c} - a.{c}" for c in ("skewness", "excess_kurtosis", *[f"acf_{g}" for g in profile.LAGS])}, "tail_frequency_change": "tl.tb - tl.ta"}
    return f"""select a.id, a.len as reference_length, b.len as post_length, {', '.join(r6(v, c) for c, v in cols.items())} from (select * from ({stats}) where side = 'a') a join (select * from ({stats}) where side = 'b') b using (id)
        join (select id, avg(case when side = 'a' then (value < lo or value > hi)::int end) as ta, avg(case when side = 'b' then (value < lo or value > hi)::int end) as tb from ({sides}) join (select id, quantile_cont(value, 0.01) as lo, quantile_cont(value, 0.99) as hi from series where period = 1 group by id) using (id) group by id) tl using (id)"""


register("break_signature", lambda s, d: six(profile.signature(from_lineitem(s, d)), ["id", "reference_length", "post_length"], _SIG), _signature_sql("select id, k, value, case when period = 1 then 'a' else 'b' end as side from series where tau_index >= 0 and (period = 1 or t >= tau_index)"))
register("break_signature_matched", lambda s, d: six(profile.signature(from_lineitem(s, d), 128), ["id", "reference_length", "post_length"], _SIG), _signature_sql(f"select id, k, value, case when t < tau_index then 'a' else 'b' end as side from (select *, least(128, tau_index, max(t) over ({P}) + 1 - tau_index) as w from series where tau_index >= 0 and period = 2) where w >= 8 and t >= tau_index - w and t < tau_index + w"))
_WH = [f"ar{p}_{c}" for p in (1, 5) for c in ("variance_ratio", "mse_ratio", "residual_std", "residual_acf_1", *[f"coefficient_{i}" for i in range(p + 1)], "half_change")]
register("whitening", lambda s, d: six(profile.whitening(from_lineitem(s, d)), ["id"], _WH))
register("age_support", lambda s, d: profile.age_support(from_lineitem(s, d)), "select t, active, positive, negative, weight from terms")
register("break_ages", lambda s, d: profile.break_ages(decisions.manifest(from_lineitem(s, d))), f"select {_BUCKET.replace('t + 1', 'tau_index + 1')} as age_range, count(*) as breaks from manifest where tau_index >= 0 group by 1")


def _copied(s: SparkSession, d: str) -> DataFrame:
    """Each tenth series again under another id, some of them with a small change."""
    x = from_lineitem(s, d)
    twin = x.filter("id % 10 = 3").withColumn("id", F.col("id") + 100000).withColumn("value", F.col("value") + F.when((F.col("id") % 20 == 3) & (F.col("k") == 5), 0.5).otherwise(0.0))
    return x.unionByName(twin)


_COPY = "(select id, k, value, period, h, n from series union all select id + 100000, k, value + case when (id + 100000) % 20 = 3 and k = 5 then 0.5 else 0.0 end, period, h, n from series where id % 10 = 3)"
register("duplicate_histories", lambda s, d: profile.duplicate_histories(_copied(s, d)), f"""select id, "first", informative from (select id, min(id) over (partition by v) as "first", n >= 16 and kinds >= 8 as informative from (select id, list(value order by k) as v, count(*) as n, count(distinct value) as kinds from {_COPY} where period = 1 group by id)) where id <> "first" """)
register("duplicate_series", lambda s, d: profile.duplicate_series(_copied(s, d)), f"""select id, "first" from (select id, min(id) over (partition by v) as "first" from (select id, list((value, period) order by k) as v from {_COPY} group by id)) where id <> "first" """)
register("repeated_blocks", lambda s, d: profile.repeated_blocks(_copied(s, d)), f"select a, b, count(*) as blocks from (select min(id) over (partition by v) as a, id as b from (select id, floor(k / 128)::int as bl, list(value order by k) as v from {_COPY} where period = 1 and floor(k / 128) < floor(h / 128) group by id, bl having count(distinct value) >= 16)) where a <> b group by a, b")
_FP = f"""(select id, length, bin, avg((value - mu) / sd) as v from (select *, h as length, avg(value) over ({P}) as mu, stddev_pop(value) over ({P}) as sd, case when k < (h % 16) * (floor(h / 16) + 1) then floor(k / (floor(h / 16) + 1)) else h % 16 + floor((k - (h % 16) * (floor(h / 16) + 1)) / floor(h / 16)) end::int as bin from {_COPY} where period = 1) where sd > 0 group by id, length, bin)"""
register("fingerprints", lambda s, d: six(profile.fingerprints(_copied(s, d)), ["id", "length", "bin"], ["v"]), f"select id, length, bin, {r6('v')} from {_FP}")
register("near_duplicates", lambda s, d: six(profile.verify_near(_copied(s, d), profile.near_candidates(_copied(s, d))), ["a", "b"], ["rms"]), f"select a, b, {r6('rms')} from (select x.id as a, y.id as b, sqrt(avg(pow(x.z - y.z, 2))) as rms from (select id, k, h, (value - avg(value) over ({P})) / stddev_pop(value) over ({P}) as z from {_COPY} where period = 1) x join (select id, k, h, (value - avg(value) over ({P})) / stddev_pop(value) over ({P}) as z from {_COPY} where period = 1) y on x.k = y.k and x.h = y.h and x.id < y.id group by x.id, y.id) where rms <= 0.01")

# Models: no SQL fits them; the tests check weights, gradients and nesting


#: What the base model reads ("base"), or all its children ("children"), or an experiment.
_CHILDREN = ("E08", "E09", "E10", "E11", "E12")


#: Line items to a pass of the frame, and most passes.
_PASS_ROWS, _PASSES = 4_000_000, 4


def _frame(s: SparkSession, d: str, through: str, root: str | None = None) -> DataFrame:
    """The columns that an experiment (or the base model, or all its children) reads: computed once, written (in root), and read by every fit."""
    x, root = from_lineitem(s, d), root or shared_folder(s)
    decisions.folds(x).write.parquet(f"{root}/folds")
    f = x.join(s.read.parquet(f"{root}/folds"), "id")  # before the blocks, where a series has its place already
    columns = dict.fromkeys(c for e in {"base": ("E08",), "children": _CHILDREN}.get(through, (through,)) for c in models.used(e, batch.COLUMNS))
    passes = max(1, min(_PASSES, table(s, d, "lineitem").count() // _PASS_ROWS))
    return batch.write(f, tuple(columns), ("target", "fold"), f"{root}/features", x, passes)


def model_scores(s: SparkSession, d: str, experiment: str) -> DataFrame:
    """Out-of-fold TS-AUC of an experiment, pooled (fold -1) and by fold.

    The frame goes once predictions are saved, before they are shuffled; what stays
    are the sums of each age and fold.
    """
    root = shared_folder(s)
    try:
        x = models.out_of_fold(_frame(s, d, experiment, root), experiment)
        x.select("t", "target", "fold", "prediction").write.option("compression", "zstd").parquet(f"{root}/predictions")
        artifacts.remove(s, f"{root}/features", f"{root}/folds")
        with batch.shuffles_dropped(s):
            scoring.fold_terms(s.read.parquet(f"{root}/predictions")).write.parquet(f"{root}/terms")
    finally:
        artifacts.remove(s, *[f"{root}/{name}" for name in ("features", "folds", "predictions")])
    return scoring.total(s.read.parquet(f"{root}/terms"), "fold")


for _e in models.EXTRAS:
    register(f"model_{_e}", lambda s, d, e=_e: model_scores(s, d, e))
register("model_E13_boosted", lambda s, d: scoring.pooled_and_folds(models.boosted(_frame(s, d, "base"))))


def full_fit(s: SparkSession, d: str) -> DataFrame:
    """Slopes of the model fitted on all series."""
    m = models.fit(_frame(s, d, "base"), "E08")
    return s.createDataFrame([("intercept", m["intercept"]), *m["slopes"].items()], "input string, slope double")


register("model_full_fit", full_fit)
register("float_transport", lambda s, d: score_frame(s, d).select("id", "t", F.col("candidate").cast("float").cast("double").alias("sent"), (F.col("candidate") == F.col("candidate").cast("float").cast("double")).alias("same")), "select id, t, candidate::float::double as sent, candidate = candidate::float::double as same from scores")

# Streams


def stream_scores(s: SparkSession, d: str) -> DataFrame:
    """The detectors over the event stream in four micro-batches, from keyed state."""
    x = from_events(s, d)
    root = shared_folder(s)
    points = x.filter("period = 2").select("id", F.col("k").cast("long").alias("ordinal"), "value", F.floor(F.col("t") / 10).alias("part"))
    schema = points.select("id", "ordinal", "value").schema
    for k in range(4):
        part = points.filter(F.col("part") == k if k < 3 else F.col("part") >= 3)
        part.select("id", "ordinal", "value").coalesce(1).write.mode("append").parquet(f"{root}/in")
    scorer.replay(s, f"{root}/in", schema, scorer.references(x), f"{root}/out", f"{root}/state")
    out = s.read.parquet(f"{root}/out")
    return six(out.filter("not late"), ["id", "ordinal"], list(scorer.SCORES))


register("stream_detectors", stream_scores, f"select id, t + h as ordinal, {', '.join(r6(f'{n}.score', n) for n in scorer.SCORES)} from " + " join ".join(f"x_{n} as {n}" + (" using (id, t)" if i else "") for i, n in enumerate(scorer.SCORES)) + " join (select id, max(h) as h from eseries group by id) using (id)")
register("event_sessions", lambda s, d: scorer.sessions(table(s, d, "events")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("events").alias("events"), F.max("events").alias("longest")), "select user_id, count(*) as sessions, sum(n)::bigint as events, max(n) as longest from (select user_id, s, count(*) as n from (select *, sum(new) over (partition by user_id order by ts) as s from (select *, coalesce((ts >= lag(ts) over (partition by user_id order by ts) + interval 6 hour)::int, 1) as new from events)) group by user_id, s) group by user_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TS-AUC of every simple detector over one shuffle of the observations."""
    return detector_scores(spark, sf_dir)
