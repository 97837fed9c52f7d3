"""Language identification by unigram pieces, summed over all segmentations.

Each language has probabilities over the pieces of a fixed public vocabulary.
A word's probability in a language is the sum, over all ways to cut it into
pieces, of the product of their probabilities; the forward algorithm computes
it for many words at once, position by position. A text's words are taken as
independent, and the language with the highest posterior wins.

Piece probabilities start from the vocabulary's own segmentation of the words of
SAMPLE learning texts of each language at most, chosen by hash; ROUNDS of
expectation-maximisation, each a job over the counted words, then replace that
one segmentation by all, with the forward and backward algorithms. Counts are
smoothed towards the pieces' counts in all languages; every text is scored
whole. LANGUAGES bounds the languages that are learnt, the commonest first.

Words are lower-cased (by Unicode) and runs of characters other than letters
and marks part them; a run of marks alone is no word. A letter outside the
vocabulary counts as one unknown piece. Defined results: null text, or text
without a letter, is "und" with score 0; with nothing to learn from every text
is "und"; repeated rows are each learnt from and scored; a null doc_id counts as
not held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lang_split

SAMPLE = 800
LANGUAGES = 256
ROUNDS = 2
MARK = "▁"  # what the vocabulary puts before a word
SMOOTH = 200.0
_MUL = 0x9E3779B97F4A7C15
REMEMBER = 200_000


def public_pieces() -> str:
    import public_tokenizers as p

    return p.path("piece_bpe_32k.model")


def letters(text: str | None) -> list[str]:
    import regex

    return regex.findall(r"\p{M}*\p{L}[\p{L}\p{M}]*", text.lower()) if text else []


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")


def _scramble(c: np.ndarray) -> np.ndarray:
    x = (c.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


class Pieces:
    """The vocabulary, keyed by hashes of character runs."""

    def __init__(self, pieces: list[str]):
        self.pieces = [p for p in pieces if p]
        self.longest = max(map(len, self.pieces), default=1)
        h = np.array([self._hash(p) for p in self.pieces], np.uint64)
        self.order = np.argsort(h)
        self.keys = h[self.order]
        # a direct table on the hash's upper bits says at once that most runs are no piece
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _hash(p: str) -> int:
        h = 0
        for c in _scramble(_codes(p)).tolist():
            h = (h * _MUL + c) % 2**64
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        some = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
        hit = self.keys[at] == h[some]
        out[some[hit]] = self.order[at[hit]]
        return out


def forward(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language. table: a row for each piece, and one for an unknown character."""
    langs, longest = table.shape[1], pieces.longest
    out = np.empty((len(words), langs))
    length = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(length, kind="stable")
    lo = 0
    while lo < len(order):
        # words of like length together, so that little is padding
        most = max(int(length[order[lo]]) + 2, int(length[order[lo]]) * 5 // 4)
        hi = int(np.searchsorted(length[order], most, "right"))
        part = order[lo : min(hi, lo + 20_000)]
        lo += len(part)
        n, t = len(part), int(length[part[-1]]) + 1
        c = np.zeros((t, n), np.uint64)
        joined = _scramble(_codes("".join(MARK + words[i] for i in part)))
        ends = np.cumsum(length[part] + 1)
        place = np.arange(len(joined)) - np.repeat(ends - length[part] - 1, length[part] + 1)
        c[place, np.repeat(np.arange(n), length[part] + 1)] = joined
        # ring[j % longest]: scaled sum over segmentations of the first j characters
        ring = np.zeros((longest, n, langs))
        ring[0] = 1.0
        scale = np.zeros(n)
        done = np.zeros(n, bool)
        back = np.zeros((longest, n), np.uint64)  # hash of the run of k + 1 characters that ends here
        for j in range(1, t + 1):
            back[1:] = back[:-1] * np.uint64(_MUL) + c[j - 1]
            back[0] = c[j - 1]
            # back[k] must be hash of characters j-1-k .. j-1
            acc = np.zeros((n, langs))
            for k in range(min(longest, j)):
                p = pieces.find(back[k])
                if k == 0:
                    acc += ring[(j - 1) % longest] * table[p]  # p = -1 takes the last row: unknown
                    continue
                hit = np.flatnonzero(p >= 0)
                if len(hit):
                    acc[hit] += ring[(j - 1 - k) % longest][hit] * table[p[hit]]
            ring[j % longest] = acc
            over = (length[part] + 1 == j) & ~done
            if over.any():
                out[part[over]] = np.log(np.maximum(acc[over], 1e-300)) + scale[over, None]
                done |= over
            if j % 4 == 0:
                top = np.maximum(acc.max(1), 1e-200)
                ring /= top[:, None]
                scale += np.log(top)
    return out


def expected(words: list[str], counts: np.ndarray, pieces: Pieces, log_p: np.ndarray) -> np.ndarray:
    """How often each piece is used in counts[i] times words[i], over all segmentations by their probability; the last entry counts unknown characters."""
    out = np.zeros(len(log_p))
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    order = np.argsort(length, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
        if not len(part):
            continue
        n, t = len(part), int(length[part[0]])
        c = _scramble(_codes("".join(MARK + words[i] for i in part))).reshape(n, t).T
        f, spans = np.full((t + 1, n), -np.inf), []
        f[0] = 0.0
        back = np.zeros((pieces.longest, n), np.uint64)
        for j in range(1, t + 1):
            back[1:] = back[:-1] * np.uint64(_MUL) + c[j - 1]
            back[0] = c[j - 1]
            for k in range(min(pieces.longest, j)):
                p = pieces.find(back[k])
                hit = np.flatnonzero(p >= 0) if k else np.arange(n)  # one character is always a piece, if an unknown one
                if len(hit):
                    p = np.where(p[hit] < 0, len(log_p) - 1, p[hit])
                    f[j, hit] = np.logaddexp(f[j, hit], f[j - 1 - k, hit] + log_p[p])
                    spans.append((j - 1 - k, j, hit, p))
        b = np.full((t + 1, n), -np.inf)
        b[t] = 0.0
        for i, j, hit, p in reversed(spans):
            b[i, hit] = np.logaddexp(b[i, hit], b[j, hit] + log_p[p])
        for i, j, hit, p in spans:
            out += np.bincount(p, np.exp(f[i, hit] + log_p[p] + b[j, hit] - f[t, hit]) * counts[part[hit]], len(out))
    return out


def _table(c: np.ndarray) -> np.ndarray:
    """Probabilities of pieces by language from counts, smoothed towards those of all languages."""
    shared = (c.sum(1) + 0.5) / (c.sum() + 0.5 * len(c))
    return (c + SMOOTH * shared[:, None]) / (c.sum(0) + SMOOTH)


def learn(docs: DataFrame, model_path=public_pieces, modulus: int = 3, most: int = SAMPLE) -> dict | None:
    """{"langs", "pieces", "table", "prior"}; None if there is nothing to learn from."""
    import sentencepiece

    spark = docs.sparkSession
    scratch = Scratch(spark)
    d = docs.filter("lang is not null and text is not null and doc_id is not null").filter(~lang_split(F.col("doc_id"), modulus, 1))
    d = d.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)).alias("u"))
    commonest = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    n = {r["lang"]: r["n"] for r in commonest}
    if not n:
        return None
    langs = sorted(n)
    rates = spark.createDataFrame([(k, i, most / n[k] * 1_000_003.0) for i, k in enumerate(langs)], "lang string, at int, rate double")
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    known = spark.sparkContext.broadcast(names)

    def words(batches):
        for b in batches:
            for at, t in zip(b.column("at").to_pylist(), b.column("text").to_pylist(), strict=True):
                if w := letters(t):
                    yield pa.RecordBatch.from_arrays([pa.array([at] * len(w), pa.int32()), pa.array(w)], ["at", "word"])

    some = d.join(F.broadcast(rates), "lang").filter("u < rate").select("at", "text")
    counted = scratch.save(some.mapInArrow(words, "at int, word string").groupBy("at", "word").agg(F.count(F.lit(1)).alias("n")), "words")

    def collected(counts: DataFrame) -> np.ndarray:
        c = np.zeros((len(names) + 1, len(langs)))
        rows = counts.groupBy("at", "piece").agg(F.sum("n").alias("n")).toArrow()  # languages times pieces at most
        c[rows["piece"].to_numpy(), rows["at"].to_numpy()] = rows["n"].to_numpy()
        return c

    def once(batches):
        s = sentencepiece.SentencePieceProcessor(model_file=model_path())
        place = {p: i for i, p in enumerate(known.value)}
        for b in batches:
            at, piece, n = [], [], []
            for k, w, m in zip(b.column("at").to_pylist(), b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                for p in s.encode(w, out_type=str):
                    at.append(k)
                    piece.append(place.get(p, len(place)))
                    n.append(float(m))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(piece, pa.int32()), pa.array(n, pa.float64())], ["at", "piece", "n"])

    kind = "at int, piece int, n double"
    table = _table(collected(counted.mapInArrow(once, kind)))
    for _ in range(ROUNDS):
        logs = spark.sparkContext.broadcast(np.log(table))

        def all_(batches, logs=logs):
            p = Pieces(known.value)
            for b in batches:
                lang, w, n = b.column("at").to_numpy(), b.column("word").to_pylist(), b.column("n").to_numpy().astype(float)
                for k in np.unique(lang):
                    own = np.flatnonzero(lang == k)
                    e = expected([w[i] for i in own], n[own], p, logs.value[:, k])
                    hit = np.flatnonzero(e)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), k, np.int32)), pa.array(hit, pa.int32()), pa.array(e[hit])], ["at", "piece", "n"])

        table = _table(collected(counted.mapInArrow(all_, kind)))
    scratch.drop(counted)
    prior = np.array([n[k] for k in langs], float)
    return {"langs": langs, "pieces": names, "table": table, "prior": np.log(prior / prior.sum())}


class Identifier:
    """Languages of texts; remembers up to REMEMBER words."""

    def __init__(self, model: dict):
        self.m, self.known, self.pieces = model, {}, Pieces(model["pieces"])
        self.logs = np.empty((0, len(model["langs"])))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        bags = [letters(t) for t in texts]
        if len(self.known) > REMEMBER:
            self.known, self.logs = {}, self.logs[:0]
        fresh = list({w for b in bags for w in b}.difference(self.known))
        if fresh:
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            self.logs = np.concatenate((self.logs, forward(fresh, self.pieces, self.m["table"])))
        langs, scores = [], []
        for b in bags:
            if not b:
                langs.append("und")
                scores.append(0.0)
                continue
            s = self.logs[list(map(self.known.__getitem__, b))].sum(0) + self.m["prior"]
            k = int(s.argmax())
            langs.append(self.m["langs"][k])
            scores.append(float(1 / np.exp(s - s[k]).sum()))
        return langs, scores


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # plain lists and arrays: executors need no package to read it

    def work(batches):
        f = Identifier(held.value) if held.value else lambda x: (["und"] * len(x), [0.0] * len(x))
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                lang, score = f(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    r = d.mapInArrow(work, "doc_id long, lang_pred string, score double")
    return r.select("doc_id", lang_split(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def language_id(docs: DataFrame) -> DataFrame:
    return identify(docs, learn(docs))
