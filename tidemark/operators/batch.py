"""The blocks of whole frames by numpy, a series at a time: the rows of blocks.features where frames are large.

A window expression sorts its rows again for every order it asks for and carries
every column along; here a series crosses to Python once and only the columns
asked for come back. Series that are long, or hold a null or a value that is not
finite, go through the windows of blocks.features, so nothing is lost or bounded.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.causal import CENTRE, DECAY_BLOCK, MIDDLE, TAIL, series
from . import blocks
from .blocks import FEWEST_PAIRS, HAC_LAGS, LONG_WINDOWS, MOMENTS, ORDER, RIDGE, SCALES, SIGN_WINDOWS, WINDOWS

LONGEST = 200_000  # rows of a series that a Python worker takes whole
CELLS = 4096  # of ids by hash, dealt to the passes of a frame
DROP = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled",)
PASSED = ("target", "fold", "tau_index")
LIKELIHOOD = ("l_plus", "l_minus", "c_plus", "c_minus", "drawdown", "trajectory_ewma")
CHANNELS = {"r": ("blk_r",), "i": ("blk_i",), "p": ("blk_p_location", "blk_p_energy"), "js": ("blk_js",), "jf": ("blk_jf",), "jr": ("blk_jr",), "ps": ("blk_ps_location", "blk_ps_energy")}



def _sources() -> dict[str, set[str]]:
    made = {"c_s": {"i", "js"}, "c_f": {"i", "jf"}, "c_r": {"i", "jr"}, "k_s": {"p", "ps"}, "mse_ratio": {"i"}}
    made |= {m: {"m"} for m in MOMENTS} | {c: {"l"} for c in LIKELIHOOD} | {"blk_p": {"p"}, "blk_ps": {"ps"}, "blk_d": {"d"}} | {f"blk_d{w}": {"d"} for w in SIGN_WINDOWS}
    made |= {c: {f} for f, names in CHANNELS.items() for n in names for c in (n, *[f"{n}{j}" for j in range(1, len(WINDOWS) + 2)])}
    return made


#: The blocks that each column of the frame is made of.
SOURCES = _sources()
COLUMNS = list(SOURCES)


def _bounded(q):
    return q / (1 + q)


def _centre(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and floored sd along the last axis."""
    return x.mean(-1), np.maximum(x.std(-1, ddof=1), 1e-8)


def _midrank(x: np.ndarray, ref: np.ndarray) -> np.ndarray:
    s = np.sort(ref)
    return ((np.searchsorted(s, x, "left") + np.searchsorted(s, x, "right")) / 2 + 0.5) / (len(s) + 1)


def _forecasts(d: np.ndarray, first: float, share: float) -> np.ndarray:
    """h[0] = first, h[k + 1] = (1 - share) * h[k] + share * d[k], in blocks so that powers stay finite."""
    keep, out = 1 - share, np.empty(len(d))
    for a in range(0, len(d), DECAY_BLOCK):
        x = d[a : a + DECAY_BLOCK]
        w = keep ** np.arange(len(x) + 1.0)
        h = w * first
        h[1:] += share / keep * w[1:] * np.cumsum(x / w[:-1])
        out[a : a + len(x)], first = h[:-1], h[-1]
    return out


def _ratio(coefficients, x: np.ndarray) -> np.ndarray:
    top, bottom = (np.polyval(c[::-1], x) for c in coefficients)
    return top / bottom


def quantile(p: np.ndarray) -> np.ndarray:
    """The standard normal quantile by the approximations of functions.causal."""
    q = p - 0.5
    r = np.sqrt(-np.log(np.where(q < 0, p, 1 - p)))
    central = np.abs(q) <= 0.425
    outer = np.where(r <= 5, _ratio(MIDDLE, r - 1.6), _ratio(TAIL, r - 5))
    return np.where(central, q * _ratio(CENTRE, np.where(central, 0.180625 - q * q, 0.0)), np.sign(q) * outer)


def _rolling(x: np.ndarray, windows: tuple[int, ...], count: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sums over the last w rows, for each w, and over all so far, with how many rows count."""
    run = np.cumsum(x, -1)
    out = []
    for w in windows:
        s = run.copy()
        s[..., w:] -= run[..., :-w]
        out.append((s, np.minimum(count, w)))
    return [*out, (run, count)]


def _correlation(m, sa, sb, saa, sbb, sab):
    with np.errstate(all="ignore"):
        va, vb = saa - sa * sa / m, sbb - sb * sb / m
        r = (sab - sa * sb / m) / np.sqrt(va * vb)
    return np.where((m > 0) & (va > 1e-12) & (vb > 1e-12), np.clip(r, -1, 1), np.nan)


def _directional(n, mean, v0: float, eta: float):
    r = np.maximum(mean, 0.0) / v0
    d = r - 1
    with np.errstate(all="ignore"):
        kernel = np.where(np.abs(d) <= 0.5, d - np.log1p(d), np.where(r > 0, d - np.log(r), 0.0))
    value = _bounded(n / 2 * np.maximum(kernel, 0.0) / eta)
    ok = (n >= FEWEST_PAIRS) & (v0 > 1e-16)
    return np.where(ok & (r > 1), value, 0.0), np.where(ok & (r == 0), 1.0, np.where(ok & (r < 1), value, 0.0))


def evidence(v: np.ndarray, h: int, cut: int, want: set[str], name: object = None) -> dict[str, np.ndarray]:
    """Columns of a series' online rows. v: all its values in order, h of them history, whose first cut rows fit."""
    n = len(v)
    c = h - cut  # of what starts at cut, the first c rows are C
    channels: dict[str, np.ndarray] = {}
    out: dict[str, np.ndarray] = {}
    if "r" in want:
        m, sd = _centre(v[cut:h])
        channels["blk_r"] = ((v[cut:] - m) / sd) ** 2
    sd = v[:cut].std(ddof=1) if cut > 1 else 0.0
    if cut < max(32, 4 * ORDER) or sd <= 1e-8:
        raise ValueError(f"history too short or constant: {name}")
    az = (v - v[:cut].mean()) / sd
    x = np.ones((ORDER + 1, n - ORDER))
    for j in range(1, ORDER + 1):
        x[j] = az[ORDER - j : n - j]
    f = x[:, : cut - ORDER]
    beta = np.linalg.solve(f @ f.T + np.diag([0.0, *[RIDGE] * ORDER]), f @ az[ORDER:cut])
    e = az[ORDER:] - beta @ x  # e[k - ORDER] is row k's
    fit, tail = e[: cut - ORDER], e[cut - ORDER :]
    m, sd = _centre(tail[:c])
    r = (tail - m) / sd
    z2 = (az[cut:h] ** 2).mean()
    out["mse_ratio"] = np.full(n - h, (tail[:c] ** 2).mean() / z2 if z2 else np.nan)
    if "i" in want:
        channels["blk_i"] = r * r
    if "p" in want:
        p = 2 * _midrank(r, r[:c]) - 1
        channels |= {"blk_p_location": p, "blk_p_energy": p * p}
    kinds = [k for k in SCALES if f"j{k}" in want or (k == "s" and want & {"ps", "m", "l"})]
    u_s = None
    if kinds:
        e2 = e * e
        b0 = max((fit * fit).mean(), 1e-16)
    for k in kinds:
        share, robust = SCALES[k]
        d = e2
        if robust:
            cap = np.quantile(fit * fit, 0.99)
            clip = np.minimum(fit * fit, cap).mean()
            d = b0 / clip * np.minimum(e2, cap) if clip > 1e-16 else e2
        scale = np.maximum(np.maximum(_forecasts(d, b0, share), 1e-16), 1e-4 * b0)
        u = (e / np.sqrt(scale))[cut - ORDER :]
        m, sd = _centre(u[:c])
        a = (u - m) / sd
        if f"j{k}" in want:
            channels[f"blk_j{k}"] = a * a
        if k == "s":
            u_s = u
            if "ps" in want:
                p = 2 * _midrank(a, a[:c]) - 1
                channels |= {"blk_ps_location": p, "blk_ps_energy": p * p}
    ages = np.arange(1.0, n - h + 1)
    names = list(channels)
    if names:
        both = np.stack([channels[k] for k in names])
        mu, sd = _centre(both[:, :c])
        parts = [_bounded(np.sqrt(w) * np.abs(s / w - mu[:, None]) / sd[:, None]) for s, w in _rolling(both[:, c:], WINDOWS, ages)]
        mean = (parts[0] + parts[1] + parts[2] + parts[3]) / 4
        for j, k in enumerate(names):
            out[k] = mean[j]
            out |= {f"{k}{i}": part[j] for i, part in enumerate(parts, 1)}
    if "d" in want:
        s = np.sign(tail - np.median(tail[:c]))
        a, b = s[: c - 1], s[1:c]
        ref = _correlation(c - 1, a.sum(), b.sum(), (a * a).sum(), (b * b).sum(), (a * b).sum())
        a, b = s[c - 1 : -1].copy(), s[c:].copy()
        a[:1] = b[:1] = 0.0  # the first online row has no pair
        for w, (sums, m) in zip(SIGN_WINDOWS, _rolling(np.stack([a, b, a * a, b * b, a * b]), tuple(w - 1 for w in SIGN_WINDOWS), ages - 1), strict=False):
            far = _bounded(np.sqrt(m) * np.abs(_correlation(m, *sums) - ref))
            out[f"blk_d{w}"] = np.where((m >= FEWEST_PAIRS) & ~np.isnan(far), far, 0.0)
        out["blk_d"] = sum(out[f"blk_d{w}"] for w in SIGN_WINDOWS) / len(SIGN_WINDOWS)
    if want & {"m", "l"}:
        nz = quantile(_midrank(u_s, u_s[:c]))
        mid = nz[:c].mean()
        away = nz - mid
        v0 = (away[:c] ** 2).mean()
    if "m" in want:
        lagged = np.concatenate(([0.0], away[1:] * away[:-1]))
        four = np.stack([nz, (nz * nz - 1) / np.sqrt(2.0), (nz**3 - 3 * nz) / np.sqrt(6.0), (nz**4 - 6 * nz * nz + 3) / np.sqrt(24.0)])
        mu, sd = _centre(four[:, :c])
        m, s = _centre(lagged[1:c])
        pair = (lagged[c:] - m) / s
        pair[:1] = 0.0
        every = [(w, np.sqrt(w) * np.abs(s / w)) for s, w in _rolling((four[:, c:] - mu[:, None]) / sd[:, None], LONG_WINDOWS, ages)]
        parts = [_bounded(q) for _, q in every]
        best = (np.maximum(np.maximum(parts[0], parts[1]), parts[2]) + parts[3]) / 2
        out |= dict(zip(MOMENTS[:4], best, strict=True))
        parts = [np.where(w >= FEWEST_PAIRS, _bounded(np.sqrt(w) * np.abs(s / np.maximum(w, 1))), 0.0) for s, w in _rolling(pair, tuple(w - 1 for w in LONG_WINDOWS), ages - 1)]
        out["m5"] = (np.maximum(np.maximum(parts[0], parts[1]), parts[2]) + parts[3]) / 2
    if "l" in want:
        q = away[:c] ** 2 - v0
        total = (q * q).sum() + sum(2 * (1 - g / (HAC_LAGS + 1)) * (q[g:] * q[:-g]).sum() for g in range(1, min(HAC_LAGS, c - 1) + 1))
        eta = max(1.0, max(total / c, 0.0) / (2 * v0 * v0)) if c >= 2 * (HAC_LAGS + 1) and v0 > 1e-16 else 1.0
        sums = _rolling(away[c:] ** 2, LONG_WINDOWS, ages)
        for kind, wide in (("l", 1.0), ("c", eta)):
            sides = [_directional(w, s / w, v0, wide) for s, w in sums]
            for i, side in enumerate(("plus", "minus")):
                parts = [x[i] for x in sides]
                out[f"{kind}_{side}"] = (np.maximum(np.maximum(parts[0], parts[1]), parts[2]) + parts[3]) / 2
        now = np.maximum(out["l_plus"], out["l_minus"])
        out["drawdown"] = np.maximum(0.0, np.maximum.accumulate(now) - now)
        out["trajectory_ewma"] = 0.99 * _forecasts(now, 0.0, 0.01) + 0.01 * now
    for k in ("p", "ps"):
        if k in want:
            out[f"blk_{k}"] = (out[f"blk_{k}_location"] + out[f"blk_{k}_energy"]) / 2
    for k in SCALES:
        if {"i", f"j{k}"} <= want:
            out[f"c_{k}"] = (out[f"blk_j{k}"] - out["blk_i"]) / np.sqrt(2.0)
    if {"p", "ps"} <= want:
        out["k_s"] = (out["blk_ps"] - out["blk_p"]) / np.sqrt(2.0)
    return out


def odd(frame: DataFrame) -> DataFrame:
    """Ids of the series that only the windows take: longer than LONGEST, or with a null or a value that is not finite."""
    v = F.col("value")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return frame.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(~finite, 1)).alias("_bad")).filter((F.col("_n") > LONGEST) | (F.col("_bad") > 0)).select("id")


def _strange(source: DataFrame) -> DataFrame | None:
    """odd(source), or None where there are none."""
    strange = odd(source)
    return strange if strange.limit(1).count() else None


def features(frame: DataFrame, columns: tuple[str, ...], passed: tuple[str, ...] = ()) -> DataFrame:
    """id, t, passed (of PASSED, as they stand on the rows) and columns of the online rows, as blocks.features gives them."""
    return _features(frame, columns, passed, _strange(frame))


def write(frame: DataFrame, columns: tuple[str, ...], passed: tuple[str, ...], path: str, source: DataFrame, passes: int) -> DataFrame:
    """features, saved in path; every series in one of so many passes.

    A pass reads the whole source and shuffles its own series only, and its shuffle's
    files go when it ends, so disk never holds the frame and the shuffle of all rows.
    Passes grow smaller as the frame grows.
    source: the same values by id, where they are cheaper to read; odd series are looked for there.
    """
    spark, strange = frame.sparkSession, _strange(source)
    with shuffles_dropped(spark):
        cell = F.pmod(F.xxhash64("id"), F.lit(CELLS))
        for first, end in dealt(passes, len(columns)):
            own = frame.filter((cell >= first) & (cell < end)) if passes > 1 else frame
            _features(own, columns, passed, strange).write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def dealt(passes: int, columns: int) -> list[tuple[int, int]]:
    """First cell and end of each pass: together all of CELLS.

    Disk holds most as a pass ends, its shuffle and the frame so far. A column of the
    frame takes about a twelfth of what the shuffle of its series takes; where each
    pass is smaller than the one before by that, none of them needs more than another.
    """
    sizes = [(1 + columns / 12) ** -k for k in range(passes)]
    ends = [round(CELLS * sum(sizes[: k + 1]) / sum(sizes)) for k in range(passes)]
    return list(zip([0, *ends[:-1]], ends, strict=True))


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside, a query's shuffle files go as it ends, not when the driver comes to collect its garbage."""
    before = {k: spark.conf.get(k, None) for k in DROP}
    try:
        for k in DROP:
            spark.conf.set(k, "true")
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _features(frame: DataFrame, columns: tuple[str, ...], passed: tuple[str, ...], strange: DataFrame | None) -> DataFrame:
    want = set().union(*[SOURCES[c] for c in columns])
    keep = ["id", "t", *passed]
    if strange is not None:
        slow = blocks.features(frame.join(strange, "id", "left_semi"), only=tuple(want | {"i"})).select(*keep, *columns)
        return _fast(frame.join(strange, "id", "left_anti"), columns, passed, want).unionByName(slow)
    return _fast(frame, columns, passed, want)


def by_series(frame: DataFrame, columns: tuple[str, ...], schema: str, made) -> DataFrame:
    """What made(table) yields of tables of whole series: id, columns, and _n, the rows of the row's series."""
    # the count holds a series together in one task; its rows are put in order there
    x = frame.select("id", *columns, F.count(F.lit(1)).over(series()).alias("_n"))

    def run(batches):
        rest: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            rest.append(b)
            ids = b.column(0)
            if len(rest) > 1 and ids[-1] == rest[0].column(0)[-1] and sum(x.num_rows for x in rest) < rest[0].column(len(columns) + 1)[-1].as_py():
                continue
            table = pa.Table.from_batches(rest)
            start = _last_start(table)
            done, left = table.slice(0, start), table.slice(start).combine_chunks()
            rest = left.to_batches()
            if done.num_rows:
                yield from made(done)
        if rest:
            yield from made(pa.Table.from_batches(rest))

    def _last_start(table: pa.Table) -> int:
        """Where the last series of the table begins."""
        ids = table.column("id").to_numpy() if pa.types.is_integer(table.schema.field("id").type) else np.asarray(table.column("id").to_pylist(), object)
        other = np.flatnonzero(ids != ids[-1])
        return int(other[-1]) + 1 if len(other) else 0

    return x.mapInArrow(run, schema)


def orders(k: np.ndarray, size: np.ndarray):
    """By series of a table: its first row, and its rows in the order of k."""
    at = 0
    while at < len(k):
        n = int(size[at])
        order = np.arange(at, at + n) if at + n <= len(k) else None
        if order is None or (size[at : at + n] != n).any():
            raise RuntimeError("a series is not whole")
        own = k[at : at + n]
        if (own[1:] < own[:-1]).any():
            order = at + np.argsort(own, kind="stable")
        yield at, order
        at += n


def _fast(frame: DataFrame, columns: tuple[str, ...], passed: tuple[str, ...], want: set[str]) -> DataFrame:
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in ("id", "t", *passed)) + "".join(f", `{c}` double" for c in columns)

    def made(table: pa.Table):
        table = table.combine_chunks()
        k, v, h, cut, size = (table.column(c).to_numpy() for c in ("k", "value", "H", "cut", "_n"))
        rows, parts = [], []
        for at, order in orders(k, size):
            past = int(h[at])
            if past < len(order):
                found = evidence(v[order].astype(float), past, int(cut[at]), want, table.column("id")[at].as_py())
                parts.append(np.stack([found[c] for c in columns]))
                rows.append(order[past:])
        if not rows:
            return
        rows, values = np.concatenate(rows), np.concatenate(parts, 1)
        some = table.select(["id", *passed]).take(pa.array(rows))
        t = pa.array((k[rows] - h[rows]).astype(np.int32))
        whole = [some.column("id").combine_chunks(), t, *[some.column(c).combine_chunks() for c in passed], *[pa.array(values[i], mask=np.isnan(values[i])) for i in range(len(columns))]]
        whole = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in whole]
        for b in pa.Table.from_arrays(whole, ["id", "t", *passed, *columns]).to_batches(max_chunksize=20_000):
            yield b

    return by_series(frame, ("k", "value", "H", "cut", *passed), schema, made)
