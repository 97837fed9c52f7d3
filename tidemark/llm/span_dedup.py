"""Removal of passages that repeat across the corpus, by sliding sentence spans.

A text is cut into sentences: after a word that ends in . ! or ?, at a line
feed, and, so that unpunctuated text has sentences too, after any word whose
hash falls in one class of CUT, and, in any LONGEST words in a row without such an
end, after the last of those of least hash. No sentence is longer than LONGEST
words. The cuts depend on the words of LONGEST words in a row alone, so a passage
is cut alike wherever it stands but for LONGEST - 1 words at each end: of any
passage of 46 words or more, at most 2 * LONGEST - 1 words at each end stay. From every sentence on, and up to every
sentence, the shortest run of at least RUN consecutive sentences and WORDS
words is hashed; runs are joined over the whole corpus by hash, and a sentence
goes if any run that covers it is not the first of its kind (least doc_id, then
place). A passage of RUN or more sentences and WORDS or more words is so covered
entirely, however short its sentences are. A text that has words but no such run
is hashed whole, as one run. dedup_spans alone leaves out the runs of more than
RUN sentences unless it is asked for them by lengthen, and whole short texts
unless by short; the query and the pipeline ask for both.

Sentences are compared by their words, with A-Z lower-cased; white space does
not matter. What stays of a text stays as it was, byte for byte.

Defined results: null text stays null and empty text empty, nothing removed;
of exact copies with different ids all but the first lose every sentence; rows
that repeat both doc_id and text are one occurrence and are treated alike; rows
without doc_id come after all others (ids are taken to be less than 2 ** 62),
and those of one text are one occurrence; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PARTS, Scratch

RUN = 3
WORDS = 8
CUT = 16
LONGEST = 8
WHOLE = -1  # stands for a whole text that has no run
LEAST_HOT = 256  # a run in fewer places is never treated as a hot one
MORE = max(WORDS - RUN, 0).bit_length()  # bits for a run's sentences beyond RUN: WORDS sentences hold WORDS words
_B, _C = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so they have inverses modulo 2 ** 64


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i for i < n, modulo 2 ** 64."""
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Cutter:
    """Sentences of a text and hashes of any run of words."""

    def __init__(self) -> None:
        self.n = 0
        self.byte = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.byte[65:91] = self.byte[97:123]
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        if n > self.n:
            self.n = n
            self.b, self.c = _powers(_B, n), _powers(_C, n)

    def __call__(self, text: bytes):
        """first byte of each sentence, number of words before each sentence (one more entry), hash(i, j) of words i to j."""
        x = np.frombuffer(text, np.uint8)
        space = (x == 32) | ((x >= 9) & (x <= 13))
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        start, end = edge[::2], edge[1::2]
        n = len(start)
        if not n:
            return start, np.zeros(1, np.int64), None
        self.grow(len(x) + 2)
        s = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(self.byte[x] * self.b[0][: len(x)], out=s[1:])
        h = (s[end] - s[start]) * self.b[1][start]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        last = x[end - 1]
        lines = np.concatenate(([0], np.cumsum(x == 10)))
        cut = (last == 46) | (last == 33) | (last == 63) | ((h >> np.uint64(20)) % np.uint64(CUT) == 0)
        cut[:-1] |= lines[start[1:]] > lines[end[:-1]]
        ends = np.concatenate(([0], np.cumsum(cut)))
        free = np.flatnonzero(ends[LONGEST:] == ends[:-LONGEST])  # LONGEST words from here on end no sentence
        at, least = free.copy(), h[free]
        for k in range(1, LONGEST):
            x = h[free + k]
            lower = x <= least
            at[lower], least[lower] = free[lower] + k, x[lower]
        cut[at] = True
        cut[-1] = True
        bounds = np.concatenate(([0], np.flatnonzero(cut) + 1))
        t = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * self.c[0][:n])))

        def run(i, j):
            r = (t[j] - t[i]) * self.c[1][i] + (j - i).astype(np.uint64)
            r = (r ^ (r >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
            return r ^ (r >> np.uint64(31))

        return start[bounds[:-1]], bounds, run


def runs_of(bounds: np.ndarray, lengthen: bool = True) -> np.ndarray:
    """The shortest runs from and up to each sentence: first sentence above MORE bits, below them the sentences beyond RUN.

    Without lengthen only those of RUN sentences.
    """
    n = len(bounds) - 1
    if n < RUN:
        return np.empty(0, np.int64)
    enough = bounds[RUN:] - bounds[:-RUN] >= WORDS
    runs = np.flatnonzero(enough) << MORE
    short = np.flatnonzero(~enough)
    if not lengthen or not len(short):
        return runs
    to = np.searchsorted(bounds, bounds[short] + WORDS)
    since = np.searchsorted(bounds, bounds[short + RUN] - WORDS, "right") - 1
    on, up = to <= n, since >= 0
    first, last = np.concatenate((short[on], since[up])), np.concatenate((to[on], short[up] + RUN))
    return np.unique(np.concatenate((runs, (first << MORE) + last - first - RUN)))


def sentences_of(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First sentence of each run, and the one after its last."""
    first = runs >> MORE
    return first, first + RUN + (runs & ((1 << MORE) - 1))


def _runs(docs: DataFrame, lengthen: bool, short: bool) -> DataFrame:
    """o, tag, i, h for every hashed run: document in order, text's tag, the run's sentences, hash of the words."""

    def work(batches):
        cutter = Cutter()
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b = big.slice(at, 500)
                which, h, place = [], [], []
                for r, t in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                    _, bounds, run = cutter(t or b"")
                    runs = runs_of(bounds, lengthen)
                    if short and not len(runs) and len(bounds) > 1:
                        place.append(np.array([WHOLE]))
                        h.append(run(bounds[:1], bounds[-1:]))
                        which.append(np.array([r]))
                    elif len(runs):
                        i, j = sentences_of(runs)
                        place.append(runs)
                        h.append(run(bounds[i], bounds[j]))
                        which.append(np.full(len(runs), r))
                if which:
                    rows = pa.array(np.concatenate(which))
                    yield pa.RecordBatch.from_arrays([b.column("o").take(rows), b.column("tag").take(rows), pa.array(np.concatenate(place), pa.int32()), pa.array(np.concatenate(h).view(np.int64))], ["o", "tag", "i", "h"])

    return docs.select("o", "tag", "text").mapInArrow(work, "o long, tag long, i int, h long")


def _with_spans(docs: DataFrame, carry: list[str], lengthen: bool = True, short: bool = True) -> DataFrame:
    """Each row of docs with its late runs, as runs_of gives them, under spans.

    Runs that many places share are few: those of more than a PARTS-th of all
    places are met by broadcast, so no task holds all places of one passage.
    """
    scratch = Scratch(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    # A row's key is its place in order and a tag of its text. Rows without an id come last, in an order of their texts.
    last = F.lit(1 << 62) + F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 62))
    d = d.withColumn("o", F.coalesce("doc_id", last)).withColumn("tag", F.xxhash64("text"))
    runs = scratch.save(_runs(d, lengthen, short), "runs")
    again = scratch.save(runs.select("h").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "again")
    level = max((again.agg(F.sum("n")).first()[0] or 0) / PARTS, LEAST_HOT)
    hot = F.broadcast(again.filter(F.col("n") > level).select("h"))  # fewer than PARTS
    place = F.struct("o", "tag", "i")

    def late(shared: DataFrame, few: bool) -> DataFrame:
        first = shared.groupBy("h").agg(F.min(place).alias("first"))
        return shared.join(F.broadcast(first) if few else first, "h").filter(place != F.col("first")).select("o", "tag", "i")

    cold = scratch.save(runs.join(hot, "h", "left_anti").join(again.filter(F.col("n") <= level).select("h"), "h"), "shared")
    gone = late(cold, False).unionByName(late(scratch.save(runs.join(hot, "h"), "hot"), True)).distinct()
    gone = scratch.save(gone.groupBy("o", "tag").agg(F.collect_list("i").alias("spans")), "gone")  # no more than one text has runs
    scratch.drop(runs, again, cold)
    return d.join(gone, ["o", "tag"], "left").select("doc_id", "text", *carry, "spans")


def dedup_spans(docs: DataFrame, lengthen: bool = False, short: bool = False) -> DataFrame:
    """doc_id, text (what is left), n_sentences, n_removed, removed_words for every row of docs (doc_id, text)."""
    return _cut(_with_spans(docs, [], lengthen, short), [])


def replace_texts(docs: DataFrame) -> DataFrame:
    """docs with what is left of each text; the same columns."""
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = {c: f"_c{i}" for i, c in enumerate(carry)}
    x = _with_spans(docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in names.items()]), list(names.values()))
    out = _cut(x, list(names.values()))
    return out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def _cut(x: DataFrame, carry: list[str]) -> DataFrame:
    """doc_id, text without the sentences in its late runs, counts, and the columns carried along."""

    def work(batches):
        cutter = Cutter()
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b = big.slice(at, 500)
                out, total, removed, words = [], [], [], []
                for t, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), strict=True):
                    starts, bounds, _ = cutter(t or b"")
                    n = len(starts)
                    gone = np.zeros(n + 1, np.int64)
                    if spans == [WHOLE]:
                        gone[0] = 1
                    elif spans:
                        i, j = sentences_of(np.array(spans, np.int64))
                        np.add.at(gone, i, 1)
                        np.add.at(gone, j, -1)
                    gone = np.cumsum(gone)[:n] > 0
                    if gone.any():
                        ends = np.append(starts[1:], len(t))
                        t = t[: starts[0]] + b"".join(t[a:z] for a, z, x in zip(starts, ends, gone, strict=True) if not x)
                    out.append(t)
                    total.append(n)
                    removed.append(int(gone.sum()))
                    words.append(int(np.diff(bounds)[gone].sum()) if n else 0)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(out, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(words, pa.int64()), *[b.column(c) for c in carry]],
                    ["doc_id", "text", "n_sentences", "n_removed", "removed_words", *carry],
                )

    kinds = "doc_id long, text string, n_sentences long, n_removed long, removed_words long"
    return x.mapInArrow(work, ", ".join([kinds, *[f"{c} {t}" for c, t in x.dtypes if c in carry]]))
