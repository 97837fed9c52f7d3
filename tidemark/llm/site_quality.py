"""Quality classification by hierarchical empirical Bayes.

A document's own evidence is a logistic model over the style of its text
(shares of symbols, capitals, digits, repeats and so on, cut into bins) and over
hashed words and character triples (log counts in HASHED buckets, by length),
fitted in numpy on SAMPLE labelled documents of each class at most; every fourth
of them is kept apart to calibrate the log odds. Only their features are
collected. Hosts and paths add theirs: a host's share of good documents is a
Beta posterior around the global share, a path's one around its host's. How
strongly each level shrinks is itself estimated, by the method of moments, from
grouped sums over all documents, so a sparse site says little and a large one
much. The global share is estimated from all documents' own evidence too, by
expectation-maximisation over its histogram, since the labelled sample is
balanced. A document's score joins its own log odds with the posterior of its
path, from which the document itself has been taken out, in place of the prior.

Defined results: a null, empty or wordless text has no evidence of its own and
counts by its site alone, but is not kept, nor counted towards its site; a null
host or path is a site of its own; repeated rows are each counted and scored,
and a labelled doc_id with several texts gives one of them to the fit; a null
doc_id is scored; with labels of one class only, or none, the own evidence is
neutral; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_counted, lang_split

SAMPLE = 3000
BINS = 10
FEATURES = 10
HASHED = 1 << 12
STEP = 0.05  # width of the histogram of own log odds
MOST = 30.0  # no calibrated log odds are larger


def style(text: bytes | None) -> np.ndarray | None:
    """Shape of a text in UTF-8, from one pass over its bytes; None without words."""
    t = text or b""
    words = t.split()
    if not words:
        return None
    n, x = len(words), np.frombuffer(t, np.uint8)
    k = np.bincount(x, minlength=256)
    chars = max(1, len(x) - int(k[32] + k[9:14].sum()))
    lines = [y for y in t.split(b"\n") if y.strip(b" \t\x0b\x0c\r")]
    upper, lower = int(k[65:91].sum()), int(k[97:123].sum())
    return np.array([
        np.log1p(n), chars / n, sum(int(k[ord(c)]) for c in "#*$%&<>") / n, int(k[124]) / n, int(k[33]) / n,
        upper / max(1, upper + lower), int(k[48:58].sum()) / chars, len(set(words)) / n, 1 - len(set(lines)) / len(lines),
        (int(k[46]) + int(k[63]) + int(k[44])) / n,
    ])


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in use and their values, of unit length: words in the lower half, character triples in the upper."""
    import zlib

    half = HASHED // 2
    words = np.fromiter((zlib.crc32(w) for w in text.lower().split()), np.int64) % half
    x = np.frombuffer(text.lower(), np.uint8).astype(np.int64)
    triples = (((x[:-2] * 257 + x[1:-1]) * 257 + x[2:]) * 2654435761 >> 7) % half + half if len(x) > 2 else np.empty(0, np.int64)
    n = np.bincount(np.concatenate((words, triples)), minlength=HASHED)
    at = np.flatnonzero(n)
    v = np.log1p(n[at])
    return at, v / math.sqrt(float(v @ v))


def _logits(m: dict, rows: list[tuple]) -> np.ndarray:
    """Uncalibrated log odds of rows (style, buckets, values)."""
    x = np.stack([r[0] for r in rows])
    at = np.stack([np.searchsorted(e, c, "right") for e, c in zip(m["edges"], x.T, strict=True)], 1) + np.arange(FEATURES) * BINS
    lengths = np.fromiter((len(r[1]) for r in rows), np.int64, len(rows))
    ids, values = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
    return m["w"][at].sum(1) + np.bincount(np.repeat(np.arange(len(rows)), lengths), m["h"][ids] * values, len(rows)) + m["bias"]


def fit(rows: list[tuple], labels: list[int], steps: int = 400) -> dict | None:
    """Bin edges, weights, and the calibration; None unless both classes occur twice. rows: (style, buckets, values)."""
    y = np.array(labels, float)
    if len(y) == 0 or min(y.sum(), (1 - y).sum()) < 2:
        return None
    apart = np.zeros(len(y), bool)
    for v in (0, 1):
        apart[np.flatnonzero(y == v)[3::4]] = True
    x, t = np.stack([r[0] for r in rows]), ~apart
    edges = np.quantile(x[t], np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    m = {"edges": edges, "w": np.zeros(FEATURES * BINS), "h": np.zeros(HASHED), "bias": 0.0}
    at = np.stack([np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)], 1) + np.arange(FEATURES) * BINS
    at, fitted, yt = at[t], [r for r, k in zip(rows, t, strict=True) if k], y[t]
    owner = np.repeat(np.arange(len(fitted)), [len(r[1]) for r in fitted])
    ids, values = np.concatenate([r[1] for r in fitted]), np.concatenate([r[2] for r in fitted])
    # both classes weigh the same: the prior is the sites' business
    wt = np.where(yt == 1, 0.5 / yt.sum(), 0.5 / (1 - yt).sum())
    sw, sh = np.full(len(m["w"]), 1e-8), np.full(HASHED, 1e-8)
    for _ in range(steps):
        z = m["w"][at].sum(1) + np.bincount(owner, m["h"][ids] * values, len(fitted)) + m["bias"]
        d = (1 / (1 + np.exp(-z)) - yt) * wt
        gw = np.bincount(at.ravel(), np.repeat(d, FEATURES), len(sw)) + 1e-4 * m["w"]
        gh = np.bincount(ids, d[owner] * values, HASHED) + 1e-4 * m["h"]
        sw, sh = sw + gw * gw, sh + gh * gh
        m["w"], m["h"], m["bias"] = m["w"] - 0.3 * gw / np.sqrt(sw), m["h"] - 0.1 * gh / np.sqrt(sh), m["bias"] - d.sum()
    held = apart if apart.any() and 0 < y[apart].mean() < 1 else t
    from .toxicity import calibrate

    z = _logits(m, [r for r, k in zip(rows, held, strict=True) if k])
    scale, shift = calibrate(z, y[held])
    # the calibration's prior goes out again: own log odds are against a neutral prior
    share = y[held].mean()
    return m | {"scale": float(max(scale, 0.0)), "shift": float(shift - math.log(share / (1 - share)))}


def own_evidence(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, host, path, own (log odds of good against a neutral prior; null without words)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        m = held.value
        for big in batches:
            for start in range(0, big.num_rows, 500):
                b = big.slice(start, 500)
                texts = b.column("text").cast(pa.binary()).to_pylist()
                shapes = [style(t) for t in texts]
                some = [i for i, v in enumerate(shapes) if v is not None]
                own: list = [None] * len(texts)
                if some:
                    z = np.zeros(len(some))
                    if m is not None:
                        z = np.clip(m["scale"] * _logits(m, [(shapes[i], *hashed(texts[i])) for i in some]) + m["shift"], -MOST, MOST)
                    for i, v in zip(some, z.tolist(), strict=True):
                        own[i] = v
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), b.column("path"), pa.array(own, pa.float64())], ["doc_id", "host", "path", "own"])

    return docs.select("doc_id", "host", "path", "text").mapInArrow(work, "doc_id long, host string, path string, own double")


def sample(docs: DataFrame, labels: DataFrame, modulus: int, most: int) -> tuple[list[tuple], list[int]]:
    """Features and labels of about most documents of each class that are not held out, chosen by hash; HASHED values a row at most."""
    lab = labels.filter("doc_id is not null and quality in (0, 1)").filter(~lang_split(F.col("doc_id"), modulus, 0))
    lab = lab.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    n = {r["quality"]: r["n"] for r in lab.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    u = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_003)) / 1_000_003.0
    share = F.when(F.col("quality") == 1, most / max(n.get(1, 0), 1)).otherwise(most / max(n.get(0, 0), 1))
    some = lab.filter(u < share).limit(3 * most)  # the limit cannot bind unless the hash fails; it bounds the broadcast

    def features(batches):
        for b in batches:
            out = []
            for i, t, y in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("quality").to_pylist(), strict=True):
                s = style(t)
                if s is not None:
                    at, v = hashed(t)
                    out.append((i, y, s.tobytes(), at.astype("<u2").tobytes(), v.astype("<f4").tobytes()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "quality", "style", "at", "v"])

    x = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", "quality")
    x = x.mapInArrow(features, "doc_id long, quality int, style binary, at binary, v binary")
    one = F.min(F.struct(F.xxhash64("style", "at"), "style", "at", "v")).alias("x")
    rows = x.groupBy("doc_id", "quality").agg(one).orderBy("doc_id").select("quality", "x.style", "x.at", "x.v").collect()  # 3 * most rows of 6 * HASHED bytes at most
    return [(np.frombuffer(r["style"]), np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["v"], "<f4").astype(float)) for r in rows], [r["quality"] for r in rows]


def _prior_strength(groups: DataFrame, n: str, good: str, mean: Column | float) -> float:
    """Pseudo-count of the Beta prior whose spread explains the groups' shares, by the method of moments."""
    m = mean if isinstance(mean, Column) else F.lit(mean)
    share = F.col(good) / F.col(n)
    x = groups.filter(F.col(n) > 0).agg(
        F.sum(F.col(n) * (share - m) * (share - m)).alias("spread"), F.sum(m * (1 - m)).alias("chance"),
        F.sum((F.col(n) - 1) * m * (1 - m)).alias("room"),
    ).first()
    if not x["room"] or x["room"] <= 0:
        return 10.0
    rho = (x["spread"] - x["chance"]) / x["room"]  # correlation of two documents of one group
    return float(min(1e4, max(1.0, 1 / rho - 1))) if rho > 0 else 1e4


def global_share(counts: list[tuple[float, int]]) -> float:
    """Share of good documents that explains a histogram (own log odds, documents) best, by expectation-maximisation; half a document of either kind smooths."""
    total, p = sum(n for _, n in counts), 0.5
    for _ in range(1000):
        prior = math.log(p / (1 - p))
        new = (sum(n / (1 + math.exp(-(z + prior))) for z, n in counts) + 0.5) / (total + 1)
        if abs(new - p) < 1e-12:
            break
        p = new
    return p


def site_quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, most: int = SAMPLE) -> DataFrame:
    """doc_id, own, host_share, path_share, score, kept for every row of docs (doc_id, text, host, path).

    host_share and path_share are the posterior means without the row itself.
    """
    scratch = Scratch(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("host").cast("string").alias("host"), F.col("path").cast("string").alias("path"))
    model = fit(*sample(d, labels, modulus, most))
    e = own_evidence(d, model)
    # null and text keys apart
    key = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(c)))
    e = scratch.save(e.select("doc_id", key("host").alias("host"), key("path").alias("path"), "own"), "evidence")
    bins = e.filter("own is not null").groupBy(F.round(F.col("own") / STEP).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    mean = global_share([(r["k"] * STEP, r["n"]) for r in bins.collect()])  # 2 * MOST / STEP bins
    prior = math.log(mean / (1 - mean))
    good = F.coalesce(1 / (1 + F.exp(-(F.col("own") + prior))), F.lit(0.0))
    paths = scratch.save(e.groupBy("host", "path").agg(F.count("own").alias("n"), F.sum(good).alias("good"), F.count(F.lit(1)).alias("rows")), "paths")
    hosts = scratch.save(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"), F.count(F.lit(1)).alias("paths")), "hosts")
    k_host = _prior_strength(hosts, "host_n", "host_good", mean)
    share = lambda g, n, k, m: F.greatest(g + k * m, F.lit(0.0)) / (n + k)
    sites = join_counted(paths, hosts, "host", "paths")
    k_path = _prior_strength(sites, "n", "good", share(F.col("host_good"), F.col("host_n"), k_host, mean))
    x = join_counted(e, sites, ["host", "path"], "rows")
    # the row's own part is taken out of its host and path
    one = F.col("own").isNotNull().cast("int")
    host = share(F.col("host_good") - good, F.col("host_n") - one, k_host, mean)
    x = x.withColumn("host_share", host)
    x = x.withColumn("path_share", share(F.col("good") - good, F.col("n") - one, k_path, F.col("host_share")))
    # at most 1e-9 of a document is lost to rounding: a share is never whole, as the global one is not
    p = F.greatest(F.least("path_share", F.lit(1 - 1e-9)), F.lit(1e-9))
    score = 1 / (1 + F.exp(-(F.coalesce("own", F.lit(0.0)) + F.log(p / (1 - p)))))
    return x.select("doc_id", "own", "host_share", "path_share", score.alias("score"), (F.col("own").isNotNull() & (score >= 0.5)).alias("kept"))
