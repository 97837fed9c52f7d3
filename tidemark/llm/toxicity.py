"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the embedding of its own hash plus the scaled sum of the
embeddings of its character 3- to 5-grams' hashes, so that words never seen
still carry what their parts say; buckets of fewer than COMMON training texts
are not trained and say nothing. The network reads windows of WINDOW words, every window
starting STRIDE words after the last and one ending with the text, so each word
but the outermost is in at least two. Attention pools the states of both
directions; a text's score is that of its highest window, calibrated on
sampled texts that the network was not trained on.

Only a text's label is known, not which of its windows earned it. Training
therefore runs in rounds: at first every window has its text's label, later a
toxic text's windows count only as far as the last round's network found them
toxic, at least the highest one.

The network is fitted on all windows of whole sampled texts: at most SAMPLE texts
of each class, chosen by hash, and no more of them, in the order of the hash,
than CHARS characters of each class hold; scoring reads whole texts.

Defined results: null, empty and wordless texts have no window and score the
share of label 1 among the labels learnt from; so does every text where those
labels are of one class only, and 0 is the share without labels; a labelled
doc_id with several texts gives one of them to the fit; repeated rows are scored
each; a null doc_id is scored like others and counts as not held out; an empty
table gives an empty result; other columns are ignored, and kept by clean().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lang_split, small_batches

SAMPLE = 1500
CHARS = 6_000_000
WINDOW, STRIDE = 32, 16
WORD_BUCKETS, GRAM_BUCKETS = 1 << 14, 1 << 16
DIM, HIDDEN, ATTEND = 16, 8, 8
COMMON = 4
RATE = 0.05
EDGE = b".,;:!?#*$%&|\"'()[]{}<>-_/\\=+~`^@"
REMEMBER = 200_000


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def word_parts(words: list[bytes]):
    """Bucket of each word, and for n = 3, 4, 5 the buckets of its n-grams with the word each belongs to."""
    import zlib

    bare = [w.strip(EDGE) or w for w in words]
    own = np.fromiter((zlib.crc32(w) % WORD_BUCKETS for w in bare), np.int64, len(bare))
    x = np.frombuffer(b"".join(b"<" + w + b">" for w in bare), np.uint8).astype(np.uint64)
    which = np.repeat(np.arange(len(bare)), np.fromiter((len(w) + 2 for w in bare), np.int64, len(bare)))
    grams = []
    for n in (3, 4, 5):
        m = len(x) - n + 1
        if m <= 0:
            grams.append((np.empty(0, np.int64), np.empty(0, np.int64)))
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(257) + x[k : k + m]
        inside = which[:m] == which[n - 1 :]
        grams.append(((_hash(h[inside]) % np.uint64(GRAM_BUCKETS)).astype(np.int64), which[:m][inside]))
    return own, grams


def _sum_by(values: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """Rows of values summed by which (in rising order)."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(which):
        at = np.flatnonzero(np.diff(which, prepend=-1))
        out[which[at]] = np.add.reduceat(values, at, axis=0)
    return out


def sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def start_weights(seed: int = 3) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = lambda *s, scale=1.0: (r.standard_normal(s) * scale / np.sqrt(s[0])).astype(np.float32)
    p = {"word": np.zeros((WORD_BUCKETS, DIM), np.float32), "gram": np.zeros((GRAM_BUCKETS, DIM), np.float32)}  # what is never trained says nothing
    for d in "fb":
        p |= {f"W{d}": w(DIM, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"U{d}": w(HIDDEN, 3 * HIDDEN)}
    return p | {"A": w(2 * HIDDEN, ATTEND), "a": np.zeros(ATTEND, np.float32), "v": w(ATTEND, scale=1.0), "o": w(2 * HIDDEN), "k": np.zeros(1, np.float32)}


def inputs(p: dict, words: list[bytes]):
    """Input vector of each word, and what the backward pass needs."""
    own, grams = word_parts(words)
    count = np.zeros(len(words), np.float32)
    x = np.zeros((len(words), DIM), np.float32)
    for ids, which in grams:
        x += _sum_by(p["gram"][ids], which, len(words))
        count += np.bincount(which, minlength=len(words)).astype(np.float32)
    share = 1 / np.sqrt(np.maximum(count, 1))
    return x * share[:, None] + p["word"][own], (own, grams, share)


def _run(gates: np.ndarray, ids: np.ndarray, u: np.ndarray, back: bool, keep: bool):
    """States of one direction over windows; gates holds each word's input part."""
    n, t = ids.shape
    h = np.zeros((n, HIDDEN), np.float32)
    states, memo = np.empty((t, n, HIDDEN), np.float32), []
    for i in range(t - 1, -1, -1) if back else range(t):
        g, a = gates[ids[:, i]], h @ u
        zr = sigmoid(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        new = np.tanh(g[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
        if keep:
            memo.append((i, h, z, r, new, a[:, 2 * HIDDEN :]))
        h = new + z * (h - new)
        states[i] = h
    return states, memo


def _pool(p: dict, states: np.ndarray, real: np.ndarray):
    t = np.tanh(states @ p["A"] + p["a"])
    s = np.where(real.T, t @ p["v"], -1e9)
    e = np.exp(s - s.max(0))
    w = e / e.sum(0)
    pooled = (w[:, :, None] * states).sum(0)
    return pooled @ p["o"] + p["k"][0], (t, w, pooled)


def logits(p: dict, gf: np.ndarray, gb: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Logit of each window; id 0 is padding."""
    states = np.concatenate((_run(gf, ids, p["Uf"], False, False)[0], _run(gb, ids, p["Ub"], True, False)[0]), 2)
    return _pool(p, states, ids > 0)[0]


def _step(p: dict, x: np.ndarray, ids: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Gradients of the weighted log loss; of x under "x"."""
    real, g = ids > 0, {}
    sf, mf = _run(x @ p["Wf"] + p["cf"], ids, p["Uf"], False, True)
    sb, mb = _run(x @ p["Wb"] + p["cb"], ids, p["Ub"], True, True)
    states = np.concatenate((sf, sb), 2)
    out, (t, w, pooled) = _pool(p, states, real)
    d = ((sigmoid(out) - y) * weight / weight.sum()).astype(np.float32)
    g["o"], g["k"] = pooled.T @ d, d.sum(keepdims=True)
    dp = d[:, None] * p["o"]
    ds = w[:, :, None] * dp
    dw = (states * dp).sum(2)
    de = w * (dw - (w * dw).sum(0)) * real.T
    g["v"] = np.einsum("tna,tn->a", t, de)
    dt = de[:, :, None] * p["v"] * (1 - t * t)
    g["A"], g["a"] = np.einsum("tnh,tna->ha", states, dt, optimize=True), dt.sum((0, 1))
    ds = ds + dt @ p["A"].T
    dx = np.zeros_like(x)
    for c, memo, part in (("f", mf, ds[:, :, :HIDDEN]), ("b", mb, ds[:, :, HIDDEN:])):
        u, du = p[f"U{c}"], np.zeros_like(p[f"U{c}"])
        dg = np.empty((*ids.shape, 3 * HIDDEN), np.float32)
        dh = np.zeros((len(ids), HIDDEN), np.float32)
        for i, h, z, r, new, an in reversed(memo):
            dh = dh + part[i]
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (h - new) * z * (1 - z)
            dr = dn * an * r * (1 - r)
            da = np.concatenate((dz, dr, dn * r), 1)
            dg[:, i] = np.concatenate((dz, dr, dn), 1)
            du += h.T @ da
            dh = dh * z + da @ u.T
        flat, at = dg.reshape(-1, 3 * HIDDEN), ids.ravel()
        order = np.argsort(at, kind="stable")
        dgx = _sum_by(flat[order], at[order], len(x))
        g[f"U{c}"], g[f"W{c}"], g[f"c{c}"] = du, x.T @ dgx, dgx.sum(0)
        dx += dgx @ p[f"W{c}"].T
    return g | {"x": dx}


def windows_of(n: int) -> np.ndarray:
    """Where the windows of a text of n words start."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    s = np.arange(0, n - WINDOW + 1, STRIDE)
    return s if s[-1] == n - WINDOW else np.append(s, n - WINDOW)


def calibrate(h: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a lightly penalised logistic fit of y on h, by damped Newton steps."""
    mean, sd = h.mean(), max(h.std(), 1e-6)
    x = np.stack(((h - mean) / sd, np.ones(len(h))), 1)
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (x @ w)).sum() + 0.05 * w[0] ** 2
    w = np.zeros(2)
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (q - y) + np.array([0.1 * w[0], 0])
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag([0.1, 1e-6]), g)
        rate = 1.0
        while rate > 1e-4 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
    return w[0] / sd, w[1] - w[0] * mean / sd


def train(texts: list[bytes], labels: np.ndarray, rounds: tuple[int, ...] = (2, 2, 2), seed: int = 3) -> dict | None:
    """Weights, with the calibration under "scale" and "shift"; None unless both labels occur."""
    labels = np.asarray(labels, np.float32)
    if len(set(labels.tolist())) < 2:
        return None
    r, p = np.random.default_rng(seed), start_weights(seed)
    vocab: dict[bytes, int] = {b"": 0}
    ids, owner = [], []
    apart = np.zeros(len(texts), bool)  # kept apart for the calibration: every fourth text of each label
    for v in (0, 1):
        apart[np.flatnonzero(labels == v)[3::4]] = True
    for k, t in enumerate(texts):
        w = [] if apart[k] else [vocab.setdefault(x, len(vocab)) for x in t.lower().split()]
        if not w:
            continue
        starts = windows_of(len(w))
        a = np.array(w + [0] * max(0, WINDOW - len(w)))
        ids.append(a[starts[:, None] + np.arange(WINDOW)])
        owner += [k] * len(starts)
    if not ids:
        return None
    ids, owner = np.concatenate(ids).astype(np.int32), np.array(owner)
    words = list(vocab)
    y = labels[owner]
    heads = np.flatnonzero(np.diff(owner, prepend=-1))
    seen = {"word": np.zeros(WORD_BUCKETS, np.int32), "gram": np.zeros(GRAM_BUCKETS, np.int32)}
    for a, z in zip(heads, np.append(heads[1:], len(owner)), strict=True):
        own, grams = word_parts([words[i] for i in np.unique(ids[a:z])])
        for name, at in (("word", own), ("gram", np.concatenate([i for i, _ in grams]))):
            seen[name][np.unique(at)] += 1
    trained = {k: (v >= COMMON)[:, None] for k, v in seen.items()}
    weight = np.ones(len(y), np.float32)
    m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items() if k not in ("word", "gram")}
    sq = {"word": np.full(WORD_BUCKETS, 1e-8, np.float32), "gram": np.full(GRAM_BUCKETS, 1e-8, np.float32)}
    step = 0
    for epochs in rounds:
        for _ in range(epochs):
            order = r.permutation(np.flatnonzero(weight > 0))
            for part in np.array_split(order, max(1, len(order) // 384)):
                step += 1
                used, local = np.unique(ids[part], return_inverse=True)
                x, (own, grams, share) = inputs(p, [words[i] for i in used])
                # padding is id 0: keep it so, also where this batch has none
                local = local.reshape(len(part), -1) + (used[0] != 0)
                if used[0] != 0:
                    x = np.concatenate((np.zeros((1, DIM), np.float32), x))
                    g = _step(p, x, local, y[part], weight[part])
                    dx = g.pop("x")[1:]
                else:
                    g = _step(p, x, local, y[part], weight[part])
                    dx = g.pop("x")
                for k, v in g.items():
                    a, b = m[k]
                    a += 0.1 * (v - a)
                    b += 0.01 * (v * v - b)
                    p[k] -= (0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
                for name, at, d in (("word", own, dx), *(("gram", i, (dx * share[:, None])[w]) for i, w in grams)):
                    o = np.argsort(at, kind="stable")
                    u, first = np.unique(at[o], return_index=True)
                    s = np.add.reduceat(d[o], first, axis=0) if len(o) else d
                    sq[name][u] += (s * s).mean(1)
                    p[name][u] -= RATE * trained[name][u] * s / np.sqrt(sq[name][u])[:, None]
        x = np.concatenate([inputs(p, words[i : i + 5000])[0] for i in range(0, len(words), 5000)])
        gf, gb = x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]
        z = np.concatenate([logits(p, gf, gb, c) for c in np.array_split(ids, max(1, len(ids) // 1024))])
        high = np.full(len(texts), -np.inf)
        np.maximum.at(high, owner, z)
        # a toxic text's window counts if it is the highest, or likely toxic by itself
        weight = np.where((y == 0) | (z >= high[owner] - 1e-6) | (sigmoid(z) > 0.5), 1.0, 0.0).astype(np.float32)
    if apart.any():
        scorer = Scorer(p)
        held = np.flatnonzero(apart)
        high, labels = np.concatenate([scorer.highest([texts[i] for i in c]) for c in np.array_split(held, max(1, len(held) // 128))]), labels[held]
    ok = np.isfinite(high)
    s, t = calibrate(high[ok], labels[ok])
    return p | {"scale": float(max(s, 0.05)), "shift": float(t)}


class Scorer:
    """Scores of texts; remembers the gates of up to REMEMBER words."""

    def __init__(self, p: dict):
        self.p, self.known, self.fresh = p, {}, []
        x, _ = inputs(p, [b""])
        self.pad = x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]
        self.forget()

    def forget(self) -> None:
        self.known, self.fresh = {}, []
        self.gates = [np.empty((1 << 12, 3 * HIDDEN), np.float32) for _ in "fb"]
        for g, v in zip(self.gates, self.pad, strict=True):
            g[0] = v
        self.n = 1

    def ids(self, words: list[bytes]) -> list[int]:
        known = self.known
        out = []
        for w in words:
            k = known.get(w)
            if k is None:
                self.fresh.append(w)
                k = known[w] = self.n
                self.n += 1
            out.append(k)
        return out

    def learn(self) -> None:
        for at in range(0, len(self.fresh), 5000):
            part = self.fresh[at : at + 5000]
            first = self.n - len(self.fresh) + at
            x, _ = inputs(self.p, part)
            for k, c in enumerate("fb"):
                while first + len(part) > len(self.gates[k]):
                    self.gates[k] = np.concatenate((self.gates[k], np.empty_like(self.gates[k])))
                self.gates[k][first : first + len(part)] = x @ self.p[f"W{c}"] + self.p[f"c{c}"]
        self.fresh = []

    def highest(self, texts: list[bytes | None]) -> np.ndarray:
        """Logit of each text's highest window; minus infinity without words."""
        if self.n > REMEMBER:
            self.forget()
        flat, starts, owner, at = [], [], [], 0
        for k, t in enumerate(texts):
            w = self.ids((t or b"").lower().split())
            if not w:
                continue
            s = windows_of(len(w))
            w += [0] * max(0, WINDOW - len(w))
            flat.append(np.array(w, np.int32))
            starts.append(s + at)
            owner.append(np.full(len(s), k))
            at += len(w)
        self.learn()
        high = np.full(len(texts), -np.inf)
        if flat:
            flat, starts, owner = np.concatenate(flat), np.concatenate(starts), np.concatenate(owner)
            for i in range(0, len(starts), 2048):
                ids = flat[starts[i : i + 2048, None] + np.arange(WINDOW)]
                np.maximum.at(high, owner[i : i + 2048], logits(self.p, *self.gates, ids))
        return high

    def __call__(self, texts: list[bytes | None], empty: float) -> list[float]:
        high = self.highest(texts)
        z = np.clip(self.p["scale"] * high + self.p["shift"], -500, 500)
        return np.where(np.isfinite(high), 1 / (1 + np.exp(-z)), empty).tolist()


def sample(docs: DataFrame, labels: DataFrame, modulus: int = 5, most: int = SAMPLE, chars: int = CHARS) -> tuple[list[bytes], np.ndarray, float]:
    """Whole texts and labels of the sample, and the share of label 1 among all labels that are not held out."""
    lab = labels.filter("doc_id is not null and toxic is not null and toxic in (0, 1)").filter(~lang_split(F.col("doc_id"), modulus, 0))
    lab = lab.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in lab.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    share = F.when(F.col("toxic") == 1, most / max(n.get(1, 0), 1)).otherwise(most / max(n.get(0, 0), 1))
    some = lab.filter(u < share).limit(3 * most)  # the limit cannot bind unless the hash fails; it bounds the broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tag = F.xxhash64("text").alias("tag")
    found = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(tag, F.coalesce(F.length("text"), F.lit(0)).alias("n"))).alias("x"))
    taken, room = [], {0: chars, 1: chars}
    for r in found.select("doc_id", "toxic", "x.tag", "x.n", u.alias("u")).orderBy("u", "doc_id").collect():  # numbers, 3 * most rows
        room[r["toxic"]] -= r["n"]
        if room[r["toxic"]] >= 0:
            taken.append((r["doc_id"], r["tag"], r["toxic"]))
    total = sum(n.values())
    base = n.get(1, 0) / total if total else 0.0
    if not taken:
        return [], np.empty(0, np.float32), base
    keys = docs.sparkSession.createDataFrame(taken, "doc_id long, tag long, toxic int")
    x = texts.withColumn("tag", F.xxhash64("text")).join(F.broadcast(keys), ["doc_id", "tag"]).dropDuplicates(["doc_id"])
    rows = x.orderBy("doc_id").select("text", "toxic").collect()  # 2 * chars characters
    return [(r["text"] or "").encode() for r in rows], np.array([r["toxic"] for r in rows], np.float32), base


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """"net" (weights, or None unless both labels occur) and "empty" (the score of a text without words)."""
    texts, y, base = sample(docs, labels)
    return {"net": train(texts, y), "empty": base}


def _scored(docs: DataFrame, model: dict, carry: list[str]) -> DataFrame:
    """carry and score of every row of docs (text, carry)."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        m = held.value
        scorer = Scorer(m["net"]) if m["net"] else None
        for big in batches:
            for at in range(0, big.num_rows, 128):
                b = big.slice(at, 128)
                s = scorer(b.column("text").cast(pa.binary()).to_pylist(), m["empty"]) if scorer else [m["empty"]] * b.num_rows
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], pa.array(s, pa.float64())], [*carry, "score"])

    d = docs.select("text", *carry)
    return d.mapInArrow(work, ", ".join([*[f"{c} {t}" for c, t in d.dtypes if c in carry], "score double"]))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    s = _scored(d, model, ["doc_id"])
    return s.select("doc_id", lang_split(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, each by itself, whose score is less than a half; the same columns."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    d = docs.select(F.col("text").cast("string").alias("text"), *[docs[c].alias(n) for c, n in names.items()])
    return _scored(d, fit(docs, labels), list(names.values())).filter("score < 0.5").select(*[F.col(n).alias(c) for c, n in names.items()])
