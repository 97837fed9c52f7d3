"""One-statistic detectors. Each adds a score in [0, 1] to every online row of a series frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.causal import bounded, decayed_sums, evidence, floored_sd, over_history, upto

#: Fixed values of the detectors: decay and scale of the mean detector, slack of CUSUM, tolerance of Page-Hinkley.
KEEP, KAPPA, SLACK, TOLERANCE = 0.95, 3.0, 0.5, 0.05


def standardised(df: DataFrame) -> DataFrame:
    """Online rows with z, against the whole history's mean and sd (0 and 1 without one)."""
    value, past = F.col("value"), F.col("period") == 1
    df = df.withColumns({"mu": F.coalesce(over_history(F.avg, past, value), F.lit(0.0)), "sd": floored_sd(past, value, 1.0)})
    df = df.withColumn("z", (value - F.col("mu")) / F.col("sd"))
    z = F.col("z")
    df = df.withColumn("ref_var", F.coalesce(over_history(F.var_samp, past, z), F.lit(1.0)))
    for name, a in (("abs", F.abs(z)), ("sq", z * z)):
        df = df.withColumns({f"ref_{name}": F.coalesce(over_history(F.avg, past, a), F.lit(0.0)), f"ref_{name}_sd": floored_sd(past, a, 1.0)})
    return df.filter("period = 2")


def ewma(df: DataFrame) -> tuple[DataFrame, Column]:
    """tanh of a third of the decayed mean's distance from the history's, in standard errors."""
    df = decayed_sums(df.withColumn("_y", F.col("value") - F.col("mu")), {"_d": ("_y", KEEP)}, "t")
    n = (1 - F.pow(F.lit(KEEP), F.col("t") + 1)) / (1 - KEEP)
    se = F.greatest(F.col("sd") / F.sqrt(F.greatest(n, F.lit(1.0))), F.lit(1e-8))
    return df, F.tanh(F.abs((1 - KEEP) * F.col("_d") / se) / KAPPA)


def cusum(df: DataFrame) -> tuple[DataFrame, Column]:
    """The larger of two one-sided sums that restart at 0: a running sum less its least value so far."""
    up = F.sum(F.col("z") - SLACK).over(upto())
    down = F.sum(-F.col("z") - SLACK).over(upto())
    df = df.withColumns({"_u": up, "_l": down})
    side = lambda c: F.col(c) - F.least(F.lit(0.0), F.min(c).over(upto()))
    return df, bounded(F.greatest(side("_u"), side("_l")))


def page_hinkley(df: DataFrame) -> tuple[DataFrame, Column]:
    """CUSUM of deviations from the running mean, this row included."""
    df = df.withColumn("_c", F.col("z") - F.avg("z").over(upto()))
    df = df.withColumns({"_u": F.sum(F.col("_c") - TOLERANCE).over(upto()), "_l": F.sum(-F.col("_c") - TOLERANCE).over(upto())})
    side = lambda c: F.col(c) - F.least(F.lit(0.0), F.min(c).over(upto()))
    return df, bounded(F.greatest(side("_u"), side("_l")))


def running_mean(df: DataFrame) -> tuple[DataFrame, Column]:
    return df, bounded(F.sqrt(F.col("t") + 1) * F.abs(F.avg("z").over(upto())))


def variance_ratio(df: DataFrame) -> tuple[DataFrame, Column]:
    ratio = F.ln(F.greatest(F.var_samp("z").over(upto()), F.lit(1e-12)) / F.greatest("ref_var", F.lit(1e-12)))
    return df, bounded(F.when(F.col("t") > 0, F.abs(ratio)).otherwise(0.0))


def absolute(df: DataFrame) -> tuple[DataFrame, Column]:
    return df, evidence(F.col("t") + 1, F.avg(F.abs("z")).over(upto()), "ref_abs", "ref_abs_sd")


def squared(df: DataFrame) -> tuple[DataFrame, Column]:
    return df, evidence(F.col("t") + 1, F.avg(F.col("z") * F.col("z")).over(upto()), "ref_sq", "ref_sq_sd")


def constant(df: DataFrame) -> tuple[DataFrame, Column]:
    return df, F.lit(0.5)


def age_only(df: DataFrame) -> tuple[DataFrame, Column]:
    return df, (F.col("t") + 1) / (F.col("t") + 2)


def perfect(df: DataFrame) -> tuple[DataFrame, Column]:
    """Control that reads the label."""
    return df, F.col("target").cast("double")


def reversed_(df: DataFrame) -> tuple[DataFrame, Column]:
    return df, 1 - F.col("target").cast("double")


DETECTORS: dict[str, Callable] = {
    "ewma": ewma, "cusum": cusum, "page_hinkley": page_hinkley, "running_mean": running_mean, "variance_ratio": variance_ratio,
    "absolute": absolute, "squared": squared, "constant": constant, "age_only": age_only, "perfect": perfect, "reversed": reversed_,
}


def detect(df: DataFrame, *names: str) -> DataFrame:
    """Online rows with one score column for each detector asked for; all share one shuffle."""
    keep = [c for c in df.columns if c not in ("n", "H", "cut", "period")]
    out = standardised(df)
    for name in names:
        if name not in DETECTORS:
            raise ValueError(f"unknown detector {name}")
        out, score = DETECTORS[name](out)
        out = out.withColumn(name, score)
    return out.select(*keep, *names)
