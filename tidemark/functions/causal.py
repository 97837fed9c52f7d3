"""Expressions over ordered series that never look ahead.

All windows partition by id, so after the one shuffle that brings a series
together every window, filter and join on id stays in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of decayed sums restart here, so that powers of the decay stay finite for streams of any length.
DECAY_BLOCK = 4096


def series() -> W:
    """All rows of a series."""
    return W.partitionBy("id")


def upto(order: str = "t") -> W:
    """All rows so far."""
    return series().orderBy(order).rowsBetween(W.unboundedPreceding, 0)


def bounded(q: Column) -> Column:
    return q / (1 + q)


def evidence(n: Column, mean: Column, ref_mean: Column | str, ref_sd: Column | str) -> Column:
    """How far a mean of n values is from its reference, on [0, 1)."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (ref_mean, ref_sd))
    return bounded(F.sqrt(n) * F.abs(mean - a) / b)


def over_history(agg, cond: Column, value: Column) -> Column:
    """An aggregate of value over the rows of a series that meet cond, on every row of the series."""
    return agg(F.when(cond, value)).over(series())


def floored_sd(cond: Column, value: Column, alone: float | None = None) -> Column:
    sd = F.stddev_samp(F.when(cond, value)).over(series())
    return F.greatest(F.coalesce(sd, F.lit(alone)) if alone is not None else sd, F.lit(1e-8))


def rolling_sums(df: DataFrame, values: dict[str, tuple[str, tuple[int, ...], Column]], order: str = "t") -> tuple[DataFrame, dict[str, list[tuple[Column, Column]]]]:
    """The frame, and for each name pairs (sum, count) of its column over the last w rows, for each w, and over all rows so far.

    values: name -> (column, windows, how many of the rows so far count). One window
    of running sums and one of their lags serve all names, whatever the widths; a
    sliding frame would cost its width for every row.
    """
    o = series().orderBy(order)
    df = df.withColumns({f"_run_{n}": F.coalesce(F.sum(c).over(upto(order)), F.lit(0.0)) for n, (c, _, _) in values.items()})
    df = df.withColumns({f"_lag{w}_{n}": F.lag(f"_run_{n}", w).over(o) for n, (_, ws, _) in values.items() for w in ws})
    out = {}
    for n, (_, ws, count) in values.items():
        # a value that is null on the first row makes a window's rows one more than its values, on both sides of the lag
        pairs = [(F.col(f"_run_{n}") - F.coalesce(F.col(f"_lag{w}_{n}"), F.lit(0.0)), F.least(count, F.lit(w))) for w in ws]
        out[n] = [*pairs, (F.col(f"_run_{n}"), count)]
    return df, out


def decayed_sums(df: DataFrame, sums: dict[str, tuple[str, float]], order: str) -> DataFrame:
    """Adds each name: the sum over rows so far of column * keep ** (rows since). sums: name -> (column, keep); order counts rows from 0 without gaps.

    Within a block of DECAY_BLOCK rows the powers are relative to the block's
    start; of earlier rows those of the block before are added, and what is older
    has decayed by keep ** DECAY_BLOCK, beyond double precision for any keep in use.
    """
    r = F.col(order) % DECAY_BLOCK
    df = df.withColumn("_b", (F.col(order) / DECAY_BLOCK).cast("int"))
    df = df.withColumns({f"_x{n}": F.coalesce(F.col(c), F.lit(0.0)) * F.pow(F.lit(1 / keep), r) for n, (c, keep) in sums.items()})
    block = W.partitionBy("id", "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    earlier = series().orderBy("_b").rangeBetween(-1, -1)
    df = df.withColumns({f"_i{n}": F.sum(f"_x{n}").over(block) for n in sums} | {f"_o{n}": F.sum(f"_x{n}").over(earlier) for n in sums})
    total = {n: F.pow(F.lit(keep), r) * F.col(f"_i{n}") + F.coalesce(F.col(f"_o{n}"), F.lit(0.0)) * F.pow(F.lit(keep), r + DECAY_BLOCK) for n, (_, keep) in sums.items()}
    return df.withColumns(total).drop("_b", *[f"_{p}{n}" for p in "xio" for n in sums])


def midrank(df: DataFrame, value: str, is_ref: Column, name: str) -> DataFrame:
    """Adds name: place of value among the series' reference rows, ties half, on (0, 1).

    (less + equal / 2 + 1 / 2) / (references + 1), reference rows ranked among themselves too.
    """
    ref = is_ref.cast("int")
    upto_value = F.sum(ref).over(series().orderBy(value).rangeBetween(W.unboundedPreceding, 0))
    equal = F.sum(ref).over(W.partitionBy("id", value))
    size = F.sum(ref).over(series())
    return df.withColumns({"_le": upto_value, "_eq": equal, "_m": size}).withColumn(name, (F.col("_le") - F.col("_eq") / 2 + F.lit(0.5)) / (F.col("_m") + 1)).drop("_le", "_eq", "_m")


def correlation(m: Column, sa: Column, sb: Column, saa: Column, sbb: Column, sab: Column) -> Column:
    """Pearson correlation from sums, within [-1, 1]; null without pairs or where either side hardly varies."""
    mean = lambda x, y: F.try_divide(x * y, m)
    va, vb = saa - mean(sa, sa), sbb - mean(sb, sb)
    r = (sab - mean(sa, sb)) / F.sqrt(va * vb)
    return F.when((m > 0) & (va > 1e-12) & (vb > 1e-12), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


#: Numerators and denominators, from the constant term on, of the rational approximations to the normal
#: quantile in M. J. Wichura, Algorithm AS 241 (PPND16), Applied Statistics 37 (1988) 477-484.
CENTRE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
MIDDLE = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
TAIL = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(coefficients, x: Column) -> Column:
    def poly(c):
        out = F.lit(c[-1])
        for k in reversed(c[:-1]):
            out = out * x + k
        return out

    return poly(coefficients[0]) / poly(coefficients[1])


def normal_quantile(df: DataFrame, p: str, name: str) -> DataFrame:
    """Adds name: the standard normal quantile of column p in (0, 1), to double precision; null stays null."""
    q = F.col(p) - 0.5
    df = df.withColumns({"_q": q, "_c": F.lit(0.180625) - q * q, "_r": F.sqrt(-F.ln(F.when(q < 0, F.col(p)).otherwise(1 - F.col(p))))})
    df = df.withColumns({"_rm": F.col("_r") - 1.6, "_rt": F.col("_r") - 5})
    outer = F.when(F.col("_r") <= 5, _ratio(MIDDLE, F.col("_rm"))).otherwise(_ratio(TAIL, F.col("_rt")))
    central = F.abs("_q") <= 0.425
    return df.withColumn(name, F.when(central, F.col("_q") * _ratio(CENTRE, F.col("_c"))).otherwise(F.signum("_q") * outer)).drop("_q", "_c", "_r", "_rm", "_rt")
