"""Language-model scores: word unigrams, and a log-bilinear class model.

Counts: the words of all training texts are counted (a grouped sum; the counts
grow with the corpus and stay distributed). The FREQUENT commonest words at
most, by a threshold on the count, are small enough to broadcast; scores of
frequent words are summed where a text is read, other words are joined to their
counts.

Model: every word has a class: the OWN commonest words one each, other words
one by their last two bytes, for the SUFFIXES commonest endings, or the rest
class; the text's end is a class too. A word's probability is that of its class
after the two classes before it, times that of the word in its class after the
class before. The WORDS commonest words are outputs of their own; a class's other
words share one output, within which a word has (c + 1) / (N + V + 1) of the
output's training tokens N and words V, the 1 being kept for unseen words. So the
model is normalised over words.

Both are log-bilinear networks, trained in numpy by noise-contrastive estimation:
a context is the sum of its classes' vectors through one matrix for each place, an
output's score the product with its own vector plus a bias. They are trained on
the counts of class triples and of (class, output) pairs of all training texts;
the classes and WORDS bound their kinds, whatever the corpus, and the number of
draws follows the number of kinds that occur. The log-probabilities of every
class after every two, and of every output in its class after every class, come
from batched matrix products with exact normalisers.

Defined results: null, empty or wordless text has one token, its end; repeated
rows are counted and scored each; a null doc_id is scored as not held out and
learnt from; with an empty training part N = V = 0; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lang_split

FREQUENT = 100_000
WORDS = 1 << 15
OWN, SUFFIXES = 96, 62
DIM = 24
NOISE, BATCH, STEPS, PASSES = 256, 2048, 800, 2


def _words(batch: pa.RecordBatch) -> list[list[bytes]]:
    return [(t or b"").lower().split() for t in batch.column("text").cast(pa.binary()).to_pylist()]


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), n over all rows of docs (text)."""

    def count(batches):
        c: Counter = Counter()

        def out():
            while c:
                keys = [k for k, _ in zip(c, range(20_000), strict=False)]
                yield pa.RecordBatch.from_pydict({"word": pa.array(keys, pa.binary()), "n": pa.array([c.pop(k) for k in keys], pa.int64())})

        for b in batches:
            for w in _words(b):
                c.update(w)
            if len(c) > 400_000:
                yield from out()
        yield from out()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Classes:
    """Classes of words. Class 0 is the end of a text and stands before its start."""

    def __init__(self, words: list[bytes], n: np.ndarray, own: int, endings: list[bytes]):
        """words in falling order of their counts n, of which the first own have a class each."""
        self.size = own + len(endings) + 2
        self.own = own
        self.by_end = {e: own + 1 + i for i, e in enumerate(endings)}
        self.rest = self.size - 1
        self.place = {w: i for i, w in enumerate(words)}
        self.kinds = np.array([i + 1 if i < own else self.by_end.get(w[-2:], self.rest) for i, w in enumerate(words)] + [0], np.int32)
        self.n = np.array([*n, 0], np.int64)
        self.out = max(own, min(WORDS, len(words)))  # words that are outputs; after them one for the rest of each class

    def read(self, texts: list[list[bytes]]):
        """Places of all words of the texts in order (-1: not frequent), the class and output of each, which are rare, and where the texts end."""
        flat = [w for t in texts for w in t]
        at = np.fromiter(map(self.place.get, flat, repeat(-1)), np.int64, len(flat))
        kinds = self.kinds[at]
        rare = np.flatnonzero(at < 0)
        if len(rare):
            kinds[rare] = [self.by_end.get(flat[i][-2:], self.rest) for i in rare.tolist()]
        outputs = np.where((at >= 0) & (at < self.out), at, self.out + kinds)
        return flat, at, kinds, outputs, rare, np.cumsum([len(t) for t in texts])


def _triples(kinds: np.ndarray, ends: np.ndarray):
    """Class before last, class before, and class of every token; the texts' ends are put in."""
    ends = np.asarray(ends, np.int64)
    full = np.insert(kinds, ends, 0)
    stops = ends + np.arange(len(ends))
    one = np.concatenate(([0], full[:-1]))
    two = np.concatenate(([0, 0], full[:-2]))[: len(full)]
    starts = np.concatenate(([0], stops[:-1] + 1)) if len(stops) else stops
    one[starts] = 0
    two[starts] = 0
    second = starts + 1
    second = second[second < len(full)]
    two[second] = 0
    return two, one, full, stops


def context_counts(docs: DataFrame, shape) -> DataFrame:
    """t, n over all rows of docs: class triples as one number, and above size ** 3 the pairs of a class and the next output."""

    def count(batches):
        c = Classes(*shape.value)
        triples, pairs = np.zeros(c.size**3, np.int32), np.zeros(c.size * (c.out + c.size), np.int32)
        for big in batches:
            for at in range(0, big.num_rows, 500):
                _, _, kinds, outputs, _, ends = c.read(_words(big.slice(at, 500)))
                two, one, now, _ = _triples(kinds, ends)
                np.add.at(triples, (two * c.size + one).astype(np.int64) * c.size + now, 1)
                some = now > c.own
                np.add.at(pairs, one[some].astype(np.int64) * (c.out + c.size) + np.insert(outputs, ends, 0)[some], 1)
        for base, total in ((0, triples), (c.size**3, pairs)):
            t = np.flatnonzero(total)
            for part in np.array_split(t, max(1, len(t) // 50_000)):
                yield pa.RecordBatch.from_arrays([pa.array(part + base), pa.array(total[part], pa.int64())], ["t", "n"])

    return docs.select("text").mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))


def _rows_add(m: np.ndarray, sq: np.ndarray, at: np.ndarray, g: np.ndarray, rate: float) -> None:
    """One step of adaptive descent on the rows at of m; repeated rows add up."""
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    rows, g = at[order][first], np.add.reduceat(g[order], first, axis=0)
    sq[rows] += g * g
    m[rows] -= (rate * g / (np.sqrt(sq[rows]) + 1e-6)).astype(np.float32)


def _contrast(size: int, outputs: int, two: np.ndarray | None, one: np.ndarray, now: np.ndarray, n: np.ndarray, seed: int) -> dict:
    """Vectors and biases that tell counted (two, one, now) from now drawn by itself; two may be left out.

    Every step draws BATCH of the counts, and NOISE outputs that serve all of them.
    """
    r = np.random.default_rng(seed)
    unigram = np.bincount(now, n, outputs) + 1.0
    noise = unigram / unigram.sum()
    log_noise = np.log(noise).astype(np.float32)
    p = {"in": r.normal(0, 0.1, (size, DIM)), "out": r.normal(0, 0.1, (outputs, DIM)), "two": np.eye(DIM) * 0.5, "one": np.eye(DIM), "bias": log_noise[:, None].copy()}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    if not len(n):
        return p
    sq = {k: np.full_like(v, 1e-4) for k, v in p.items()}
    heap, cum = np.cumsum(n), np.cumsum(noise)
    steps = max(STEPS, -(-PASSES * len(n) // BATCH))
    for step in range(steps):
        rate = 0.1 * (1 - 0.9 * step / steps)
        k = np.minimum(np.searchsorted(heap, r.random(BATCH) * heap[-1], "right"), len(n) - 1)
        y, b = now[k], one[k]
        z = np.minimum(np.searchsorted(cum, r.random(NOISE)), outputs - 1)
        ctx = p["in"][b] @ p["one"]
        if two is not None:
            a = two[k]
            ctx += p["in"][a] @ p["two"]
        base = log_noise + np.float32(np.log(NOISE))
        d_y = (1 / (1 + np.exp(-((ctx * p["out"][y]).sum(1) + p["bias"][y, 0] - base[y]))) - 1)[:, None] / BATCH
        d_z = 1 / (1 + np.exp(-(ctx @ p["out"][z].T + p["bias"][z, 0] - base[z]))) / BATCH
        g = d_y * p["out"][y] + d_z @ p["out"][z]
        at = np.concatenate((y, z))
        _rows_add(p["out"], sq["out"], at, np.concatenate((d_y * ctx, d_z.T @ ctx)), rate)
        _rows_add(p["bias"], sq["bias"], at, np.concatenate((d_y, d_z.sum(0)[:, None])), rate)
        places = [("one", b)] if two is None else [("one", b), ("two", a)]
        moved = [(name, p["in"][c].T @ g) for name, c in places]
        _rows_add(p["in"], sq["in"], np.concatenate([c for _, c in places]), np.concatenate([g @ p[name].T for name, _ in places]), rate)
        for name, v in moved:
            sq[name] += v * v
            p[name] -= (rate * v / (np.sqrt(sq[name]) + 1e-6)).astype(np.float32)
    return p


def train(size: int, triples: np.ndarray, n: np.ndarray, seed: int = 11) -> np.ndarray:
    """Log probability (natural) of each class after each pair of classes, as an array (size * size, size)."""
    kind = np.min_scalar_type(size)
    two, one, now = ((triples // d % size).astype(kind) for d in (size * size, size, 1))
    p = _contrast(size, size, two, one, now, n, seed)
    left, right = p["in"] @ p["two"], p["in"] @ p["one"]
    out = np.empty((size * size, size), np.float32)
    for i in range(size):
        s = (left[i] + right) @ p["out"].T + p["bias"][:, 0]
        top = s.max(1, keepdims=True)
        out[i * size : (i + 1) * size] = s - top - np.log(np.exp(s - top).sum(1, keepdims=True))
    return out


def train_outputs(c: Classes, pairs: np.ndarray, n: np.ndarray, seed: int = 12) -> np.ndarray:
    """Log probability (natural) of each output in its class after each class, as an array (size, out + size)."""
    outputs = c.out + c.size
    p = _contrast(c.size, outputs, None, pairs // outputs, pairs % outputs, n, seed)
    kinds = np.concatenate((c.kinds[: c.out], np.arange(c.size)))
    s = p["in"] @ p["one"] @ p["out"].T + p["bias"][:, 0]
    order = np.argsort(kinds, kind="stable")
    first = np.flatnonzero(np.diff(kinds[order], prepend=-1))  # every class has an output for its rest
    top = np.maximum.reduceat(s[:, order], first, axis=1)
    total = top + np.log(np.add.reduceat(np.exp(s[:, order] - top[:, kinds[order]]), first, axis=1))
    s -= total[:, kinds]
    s[:, : c.own] = 0.0  # alone in their class
    return s.astype(np.float32)


def score(docs: DataFrame, modulus: int = 7, rest: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = lang_split(F.col("doc_id"), modulus, rest)
    lessons = d.filter(~held)
    n_texts = lessons.count()
    counts = scratch.save(word_counts(lessons), "counts")
    # The least step of the count at which no more than FREQUENT words are commoner.
    level = F.floor(F.log2("n") * 8).cast("int")
    steps = sorted(((r["l"], r["k"]) for r in counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)  # at most 8 * 64
    floor_, taken = None, 0
    for lev, k in steps:
        taken += k
        if taken > FREQUENT:
            break
        floor_ = lev
    frequent = counts.filter(level >= floor_) if floor_ is not None else counts.limit(0)
    frequent = frequent.select("word", "n").toArrow()  # FREQUENT at most
    frequent = sorted(zip(frequent["word"].to_pylist(), frequent["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    words, n_words = [w for w, _ in frequent], np.array([n for _, n in frequent], np.int64)
    own = words[:OWN]
    end2 = F.substring("word", -2, 2)
    others = counts.filter(~F.col("word").isin([bytearray(w) for w in own])) if own else counts
    per_end = others.groupBy(end2.alias("e")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    per_end = {bytes(r["e"]): (r["n"], r["v"]) for r in per_end.collect()}  # at most 256 + 65536 endings
    endings = sorted(per_end, key=lambda e: (-per_end[e][0], e))[:SUFFIXES]
    shape = (words, n_words, len(own), endings)
    classes = Classes(*shape)
    total = int(n_words[: len(own)].sum()) + sum(n for n, _ in per_end.values()) + n_texts
    kinds = len(own) + sum(v for _, v in per_end.values()) + (n_texts > 0)
    # N + V + 1 of the rest of each class: what is no output of its own
    room = np.ones(classes.size)
    for e, (n, v) in per_end.items():
        room[classes.by_end.get(e, classes.rest)] += n + v
    np.subtract.at(room, classes.kinds[len(own) : classes.out], n_words[len(own) : classes.out] + 1)
    shipped = spark.sparkContext.broadcast(shape)
    rows = context_counts(lessons, shipped).select("t", F.col("n").cast("double")).toArrow()  # size ** 3 + size * (WORDS + size) rows at most
    t, n = rows["t"].to_numpy(), rows["n"].to_numpy()
    cut = t < classes.size**3
    model = train(classes.size, t[cut], n[cut]), train_outputs(classes, t[~cut] - classes.size**3, n[~cut])
    del rows, t, n
    held_model = spark.sparkContext.broadcast(model)
    log_all = float(np.log10(total + kinds + 1))
    end_base = float(np.log10(n_texts + 1)) - log_all
    log_room = np.log10(room)
    by_end_room = {e: float(log_room[k]) for e, k in classes.by_end.items()}
    rest_room = float(log_room[classes.rest])
    del classes

    def read(batches):
        c, (table, inner) = Classes(*shipped.value), held_model.value
        size = c.size
        own_base = np.log10(c.n + 1.0)
        own_share = np.where(np.arange(len(c.n)) < c.out, 0.0, np.log10(c.n + 1.0) - log_room[c.kinds])
        part, serial = TaskContext.get().partitionId(), 0
        for big in batches:
            for at_ in range(0, big.num_rows, 250):
                b = big.slice(at_, 250)
                texts = _words(b)
                flat, at, kinds_, outputs, rare, ends = c.read(texts)
                two, one, now, stops = _triples(kinds_, ends)
                lm = (table[(two * size + one).astype(np.int64), now] + inner[one, np.insert(outputs, ends, c.out)]) / np.log(10)
                sums = np.diff(np.concatenate(([0.0], np.cumsum(lm, dtype=np.float64)[stops])))
                base = np.where(at < 0, 0.0, own_base[at])
                share = np.where(at < 0, 0.0, own_share[at])
                edges = np.concatenate(([0], ends))
                cb, cs, ck = (np.concatenate(([0.0], np.cumsum(x)))[edges] for x in (base, share, (at >= 0).astype(float)))
                n = np.diff(edges)
                rid = (part << 40) + serial + np.arange(len(texts))
                serial += len(texts)
                m = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(rid), pa.nulls(m, pa.binary()), pa.array(n + 1), pa.array((np.diff(ck) + (n_texts > 0)).astype(np.int64)), pa.array(np.diff(cb) - (n + 1) * log_all + end_base + log_all), pa.array(sums + np.diff(cs))],
                    ["doc_id", "rid", "word", "n", "known", "base", "lm"],
                )
                if len(rare):
                    owner = np.searchsorted(ends, rare, "right")
                    bag = Counter(zip(owner.tolist(), map(flat.__getitem__, rare.tolist()), strict=True))
                    who = np.fromiter((k[0] for k in bag), np.int64, len(bag))
                    w = [k[1] for k in bag]
                    z = len(bag)
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(z, pa.int64()), pa.array(rid[who]), pa.array(w, pa.binary()), pa.array(list(bag.values()), pa.int64()), pa.nulls(z, pa.int64()), pa.nulls(z, pa.float64()), pa.array([by_end_room.get(x[-2:], rest_room) for x in w], pa.float64())],
                        ["doc_id", "rid", "word", "n", "known", "base", "lm"],
                    )

    both = scratch.save(d.mapInArrow(read, "doc_id long, rid long, word binary, n long, known long, base double, lm double"), "read")
    texts = both.filter("word is null").select("doc_id", "rid", "n", "known", "base", "lm")
    rest_counts = counts.filter(level < floor_) if floor_ is not None else counts
    x = both.filter("word is not null").select("rid", "word", "n", "lm").join(rest_counts.select("word", F.col("n").alias("c")), "word", "left")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + 1.0)
    x = x.groupBy("rid").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known2"),
        F.sum(F.col("n") * log_c).alias("base2"),
        F.sum(F.col("n") * (log_c - F.col("lm"))).alias("lm2"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return texts.join(x, "rid", "left").select(
        "doc_id", lang_split(F.col("doc_id"), modulus, rest).alias("held_out"), F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base2")).alias("base_score"), (F.col("lm") + zero("lm2")).alias("score"),
    )
