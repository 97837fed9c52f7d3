"""Weighted logistic models over evidence blocks, fitted out of fold; boosted trees as an alternative.

Every training row weighs its age's pairs, split between the classes; inputs
are standardised with those weights, a constant one to 0. The penalty is on the
slopes alone.
"""

from __future__ import annotations

import json
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import training_weights

PENALTY = 0.01
GRADIENT = 1e-6  # no entry of the loss's gradient may be larger after a fit
FLAT = 1e-10  # a fit ends where none is
STEPS = 60  # passes over the rows that a fit may take
LEAST_LEAF = 10_000  # rows in a leaf of a boosted tree
BASE = ("blk_r", "blk_i", "blk_p", "blk_d")
_R2, _R6, _R12 = 2**0.5, 6**0.5, 12**0.5

#: Columns that an experiment adds to the base four; z_<block> are standardised blocks, centre is a training mean.
EXTRAS: dict[str, dict[str, str]] = {
    "E08": {},
    "E09": {"q_r": "(q - q_centre) * z_blk_r", "q_i": "(q - q_centre) * z_blk_i"},
    "E10": {"x1": f"(blk_i1 - blk_i2) / {_R2!r}D", "x2": f"(blk_i1 + blk_i2 - 2 * blk_i3) / {_R6!r}D", "x3": f"(blk_i1 + blk_i2 + blk_i3 - 3 * blk_i4) / {_R12!r}D"},
    "E11": {"x": f"(blk_p_energy - blk_p_location) / {_R2!r}D"},
    "E12": {"a_i": "(a - a_centre) * z_blk_i", "a_p": "(a - a_centre) * z_blk_p", "a_d": "(a - a_centre) * z_blk_d"},
    "E14": {"c_s": "c_s"}, "E15": {"c_f": "c_f"}, "E16": {"c_r": "c_r"}, "E17": {"c_s": "c_s", "k_s": "k_s"},
    "E18": {"c_s": "c_s", **{f"m{i}": f"m{i}" for i in range(1, 6)}},
    "E19": {"c_s": "c_s", "l_plus": "l_plus", "l_minus": "l_minus"},
    "E20": {"c_s": "c_s", "l_plus": "l_plus", "l_minus": "l_minus", "drawdown": "drawdown", "trajectory_ewma": "trajectory_ewma"},
    "E21": {"c_s": "c_s", "c_plus": "c_plus", "c_minus": "c_minus"},
}


def with_context(df: DataFrame) -> DataFrame:
    """Adds q, the history's predictability (0 where unknown), and a, the log age."""
    q = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("mse_ratio"))), F.lit(0.0))
    return df.withColumns({"q": q, "a": F.log1p((F.col("t") + 1).cast("double"))})


def _scale(name: str, mean: float, sd: float) -> Column:
    return (F.col(name) - mean) / sd if sd > 0 else F.lit(0.0)


def prepare(df: DataFrame, pre: dict) -> DataFrame:
    """Adds the model's inputs z_...: the base four, then the experiment's extras, standardised apart."""
    df = df.withColumns({f"z_{c}": _scale(c, *pre["base"][c]) for c in BASE})
    df = df.withColumns({"q_centre": F.lit(pre["q"]), "a_centre": F.lit(pre["a"])})
    for name, sql in EXTRAS[pre["experiment"]].items():
        df = df.withColumn(f"_x_{name}", F.expr(sql))
        mean_sd = pre.get("extra", {}).get(name)
        if mean_sd:
            df = df.withColumn(f"zx_{name}", _scale(f"_x_{name}", *mean_sd)).drop(f"_x_{name}")
    return df


def inputs(experiment: str) -> list[str]:
    return [f"z_{c}" for c in BASE] + [f"zx_{n}" for n in EXTRAS[experiment]]


def used(experiment: str, available: list[str]) -> list[str]:
    """The columns of a frame that an experiment's model reads."""
    words = {w for sql in EXTRAS[experiment].values() for w in re.findall(r"[a-z_]\w*", sql)}
    return [*BASE, "mse_ratio", *sorted((words & set(available)) - {*BASE, "mse_ratio", "t", "target"})]


def _omegas(x: DataFrame, folds: list[int | None]) -> np.ndarray:
    """training_weights as a table: by fold left out, age and class. As many ages as the longest series has rows."""
    n = x.groupBy("fold", "t").agg(F.sum("target").alias("p"), F.count(F.lit(1)).alias("n")).toPandas()
    ages = int(n["t"].max()) + 1 if len(n) else 0
    out = np.zeros((len(folds), ages, 2))
    for i, k in enumerate(folds):
        rest = n if k is None else n[n["fold"] != k]
        pos = np.bincount(rest["t"].astype(int), rest["p"].astype(float), ages)
        neg = np.bincount(rest["t"].astype(int), (rest["n"] - rest["p"]).astype(float), ages)
        pairs = pos * neg
        if not pairs.sum():
            raise ValueError("no age has both classes")
        with np.errstate(divide="ignore", invalid="ignore"):
            for y, rows in ((0, neg), (1, pos)):
                out[i, :, y] = np.where(pairs > 0, pairs / (2 * pairs.sum() * rows), 0.0)
    return out


def _sums(x: DataFrame, folds: list[int | None], omega: np.ndarray, names: list[list[str]], of) -> list[list[np.ndarray]]:
    """For each fold left out, what of(i, columns, target, omega) gives for the rows of every batch."""
    wanted = list(dict.fromkeys(c for own in names for c in own))
    x = x.select("fold", "t", "target", *wanted)
    sent = x.sparkSession.sparkContext.broadcast(omega)

    def run(batches):
        for b in batches:
            fold, t, y = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cols = {c: b.column(3 + i).to_numpy(zero_copy_only=False).astype(float, copy=False) for i, c in enumerate(wanted)}
            for i, k in enumerate(folds):
                w = sent.value[i][t, y]
                w = w if k is None else np.where(fold == k, 0.0, w)
                on = np.flatnonzero(w)
                if len(on):
                    made = of(i, np.stack([cols[c][on] for c in names[i]]), y[on], w[on])
                    yield i, made

    def run_arrow(batches):
        found: dict[int, np.ndarray | None] = {}
        for i, made in run(batches):
            found[i] = made if i not in found else merged(found[i], made)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.ravel().tolist() for v in found.values()], pa.list_(pa.float64()))], ["i", "v"])

    merged = of.merge
    out: list[list[np.ndarray]] = [[] for _ in folds]
    for r in x.mapInArrow(run_arrow, "i int, v array<double>").collect():
        out[r["i"]].append(np.array(r["v"]))
    sent.unpersist()
    return out


class _Moments:
    """Weight, mean, squared deviations, least and greatest of each column."""

    def __call__(self, i, x, y, w):
        n = w.sum()
        mean = x @ w / n
        away = x - mean[:, None]
        return np.stack([np.full(len(x), n), mean, (away * away) @ w, x.min(1), x.max(1)])

    def merge(self, a, b):
        n = a[0] + b[0]
        d = b[1] - a[1]
        return np.stack([n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n, np.minimum(a[3], b[3]), np.maximum(a[4], b[4])])


class _Newton:
    """Loss, gradient and Hessian of the unpenalised loss at points: (intercept and slopes, means, sds) for each fold."""

    def __init__(self, points):
        self.points = points

    def __call__(self, i, x, y, w):
        beta, mean, sd = self.points[i]
        z = np.ones((len(x) + 1, x.shape[1]))
        z[1:] = np.where(sd[:, None] > 0, (x - mean[:, None]) / np.where(sd > 0, sd, 1.0)[:, None], 0.0)
        logit = beta @ z
        p = np.exp(-np.logaddexp(0.0, -logit))
        loss = w @ (np.logaddexp(0.0, logit) - y * logit)
        return np.concatenate(([loss], z @ (w * (p - y)), ((z * (w * p * (1 - p))) @ z.T).ravel()))

    def merge(self, a, b):
        return a + b


def _moments(x: DataFrame, folds: list[int | None], omega: np.ndarray, names: list[list[str]]) -> list[dict[str, tuple[float, float]]]:
    """By fold left out: mean and sd of columns under the weights; a constant one has its value and exactly 0."""
    kind, out = _Moments(), []
    for own, parts in zip(names, _sums(x, folds, omega, names, kind), strict=True):
        n, mean, m2, lo, hi = reduce(kind.merge, [v.reshape(5, -1) for v in parts])
        out.append({c: (float(lo[j]), 0.0) if lo[j] == hi[j] else (float(mean[j]), float(np.sqrt(m2[j] / n[j]))) for j, c in enumerate(own)})
    return out


def fits(df: DataFrame, experiment: str, folds: list[int | None]) -> list[dict]:
    """A model for each fold left out (None: none), all from the same passes over the rows, by Newton's method."""
    if experiment not in EXTRAS:
        raise ValueError(f"unknown experiment {experiment}")
    if not folds:
        return []
    fold = F.lit(-1).cast("int") if folds == [None] else F.col("fold").cast("int")
    x = with_context(df.select(fold.alias("fold"), "t", F.col("target").cast("int").alias("target"), *used(experiment, df.columns)))
    omega = _omegas(x, folds)
    m = _moments(x, folds, omega, [[*BASE, "q", "a"]] * len(folds))
    pres = [{"experiment": experiment, "base": {c: v[c] for c in BASE}, "q": v["q"][0], "a": v["a"][0]} for v in m]
    extra = list(EXTRAS[experiment])
    names = [[*BASE, *extra] for _ in folds]
    if extra:
        if any(c not in x.columns for c in extra):  # made of a fold's own standardised columns
            own = set(x.columns)
            for i, pre in enumerate(pres):
                x = prepare(x, pre).select(*[c for c in x.columns if c in own or c.startswith("_f")], *[F.col(f"_x_{n}").alias(f"_f{i}_{n}") for n in extra])
                names[i] = [*BASE, *[f"_f{i}_{n}" for n in extra]]
        for i, v in enumerate(_moments(x, folds, omega, [own[len(BASE) :] for own in names])):
            pres[i]["extra"] = dict(zip(extra, v.values(), strict=True))
    scales = [np.array([*pre["base"].values(), *pre.get("extra", {}).values()]) for pre in pres]
    size = len(names[0]) + 1
    ridge = np.diag([0.0, *[PENALTY] * (size - 1)])
    best: list[tuple | None] = [None] * len(folds)  # point, loss, gradient, step
    trial = [np.zeros(size) for _ in folds]
    open_ = list(range(len(folds)))
    for _ in range(STEPS):
        points = [(trial[i], scales[i][:, 0], scales[i][:, 1]) for i in open_]
        found = _sums(x, [folds[i] for i in open_], omega[open_], [names[i] for i in open_], _Newton(points))
        for i, parts in zip(list(open_), found, strict=True):
            v = np.sum(parts, 0)
            if not np.isfinite(v).all():
                raise ValueError("null or non-finite inputs")
            b = trial[i]
            loss, g, h = v[0] + b @ ridge @ b / 2, v[1 : size + 1] + ridge @ b, v[size + 1 :].reshape(size, size) + ridge
            if best[i] is not None and not loss <= best[i][1] + 1e-12 * abs(best[i][1]):
                best[i] = (*best[i][:3], best[i][3] / 2)  # too far
            else:
                best[i] = (b, loss, g, -np.linalg.solve(h, g))
            trial[i] = best[i][0] + best[i][3]
            if np.abs(best[i][2]).max() <= FLAT:
                open_.remove(i)
        if not open_:
            break
    for i in range(len(folds)):
        if not (slope := np.abs(best[i][2]).max()) <= GRADIENT:  # the penalised loss must be flat where the fit stopped
            raise RuntimeError(f"the fit of {experiment} did not converge: gradient {slope:.2e}")
    return [pre | {"intercept": float(b[0][0]), "slopes": dict(zip(inputs(experiment), map(float, b[0][1:]), strict=True))} for pre, b in zip(pres, best, strict=True)]


def fit(df: DataFrame, experiment: str) -> dict:
    """A model as plain values: preprocessing, intercept, slopes by input name."""
    return fits(df, experiment, [None])[0]


def predict(df: DataFrame, model: dict, name: str = "prediction") -> DataFrame:
    """Adds (or replaces) the model's probability, as one expression without Python."""
    keep = [c for c in df.columns if c != name]
    x = prepare(with_context(df), model)
    logit = reduce(lambda a, b: a + b, [F.lit(v) * F.col(k) for k, v in model["slopes"].items()], F.lit(model["intercept"]))
    return x.withColumn(name, 1 / (1 + F.exp(-logit))).select(*keep, name)


def out_of_fold(df: DataFrame, experiment: str, folds: int = 5) -> DataFrame:
    """df (with fold) and prediction: each fold by a model fitted on the others."""
    keep = [c for c in df.columns if c != "prediction"]
    x = df.filter(F.col("fold").between(0, folds - 1)).select(*keep)
    for k, model in enumerate(fits(df, experiment, list(range(folds)))):
        x = predict(x, model, f"_p{k}")
    own = reduce(lambda a, k: a.when(F.col("fold") == k, F.col(f"_p{k}")), range(1, folds), F.when(F.col("fold") == 0, F.col("_p0")))
    return x.withColumn("prediction", own).select(*keep, "prediction")


def boosted(df: DataFrame, folds: int = 5, **settings) -> DataFrame:
    """Out-of-fold boosted trees on the base four: shallow, slow, many bins, no small leaves."""
    from .boosting import boosted as grown

    return grown(df, folds, **settings)


def gradient(df: DataFrame, model: dict) -> DataFrame:
    """input, gradient of the penalised loss at the model: all near 0 once it has converged."""
    x = training_weights(df)
    x = predict(x, model, "_p")
    x = prepare(with_context(x), model)
    err = F.col("omega") * (F.col("_p") - F.col("target"))
    one = x.agg(F.sum(err).alias("intercept"), *[(F.sum(err * F.col(k)) + PENALTY * v).alias(k) for k, v in model["slopes"].items()])
    return one.select(F.explode(F.create_map(*[c for k in one.columns for c in (F.lit(k), F.col(k))])).alias("input", "gradient"))


def dumps(model: dict) -> bytes:
    """Canonical bytes of a model: the same model always gives the same ones."""
    return json.dumps(model, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()


def loads(data: bytes) -> dict:
    m = json.loads(data)
    if m.get("experiment") not in EXTRAS or list(m["slopes"]) != sorted(inputs(m["experiment"])):
        raise ValueError("not a model of this engine")
    m["slopes"] = {k: m["slopes"][k] for k in inputs(m["experiment"])}
    m["base"] = {k: tuple(v) for k, v in m["base"].items()}
    if "extra" in m:
        m["extra"] = {k: tuple(v) for k, v in m["extra"].items()}
    return m


def raw_slopes(model: dict) -> dict[str, float]:
    """Slopes per unit of the unscaled inputs; 0 for a constant one."""
    scale = {f"z_{k}": v[1] for k, v in model["base"].items()} | {f"zx_{k}": v[1] for k, v in model.get("extra", {}).items()}
    return {k: v / scale[k] if scale[k] > 0 else 0.0 for k, v in model["slopes"].items()}


def consistency(models: list[dict]) -> dict[str, dict]:
    """Over folds, by input: least, greatest and mean slope, and how many are positive."""
    out = {}
    for k in models[0]["slopes"]:
        v = [m["slopes"][k] for m in models]
        out[k] = {"min": min(v), "max": max(v), "mean": sum(v) / len(v), "positive": sum(x > 0 for x in v)}
    return out
