"""Best-fit packing of tokenised documents into sequences of fixed length.

Lengths are whole numbers up to the capacity, so the packing is worked out on
the histogram of lengths (at most CAPACITY entries, whatever the corpus) and
then dealt out: large pieces, above a third of the capacity, go at most two to
a sequence, each with the largest partner that still fits; smaller pieces, in
falling order, go to the tightest gap that holds them, and open sequences only
where no gap does. Equal sequences are planned as one pattern with a count.
A piece finds its place from its rank among pieces of its length; ranks come
from counts of (length, bucket), as many buckets of RANK pieces as a length
needs, dealt by a number that each piece got when it was written, so neither a
length nor equal rows are a hot key.

Defined results: a null text is an empty one, whose tokens are the end token
alone; repeated rows are packed each; a null doc_id is packed like others; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, kept

CAPACITY = 2048
RANK = 500
END = 0


def encoder(json_path: str, ranks_path: str, pattern: str):
    """A function from texts to lists of ids, equal to the json tokenizer's without added special tokens.

    The rank file holds the same vocabulary and is read by a faster library;
    texts that spell out a special token go through the json tokenizer.
    """
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(json_path)
    special = [t.content for t in exact.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def public_encoder():
    import public_tokenizers as p

    return kept("byte_bpe_50k", lambda: encoder(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN))


def pieces(docs: DataFrame, make_encoder=public_encoder, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. Only documents over the capacity are cut; their first piece is the shorter one."""

    def work(batches):
        encode = make_encoder()
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                b = big.slice(at, 1000)
                row, piece, start, length, crc = [], [], [], [], []
                for r, t in enumerate(b.column("text").to_pylist()):
                    ids = np.array([*encode(t or ""), END], "<u4")
                    n = -(-len(ids) // capacity)
                    first = len(ids) - (n - 1) * capacity
                    for k in range(n):
                        a, z = (0, first) if k == 0 else (first + (k - 1) * capacity, first + k * capacity)
                        row.append(r)
                        piece.append(k)
                        start.append(a)
                        length.append(z - a)
                        crc.append(zlib.crc32(ids[a:z].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (how many sequences, [(length, how many in each)]) that use up the counts."""
    left = {n: c for n, c in counts.items() if c > 0}
    third = capacity // 3
    bins: dict[int, list] = {}  # gap -> [(how many, items)]
    gaps: list[int] = []

    def put(gap: int, many: int, items: list) -> None:
        if many:
            if gap not in bins:
                bins[gap] = []
                bisect.insort(gaps, gap)
            bins[gap].append((many, items))

    large = sorted(n for n in left if n > third)
    while large:
        a = large[-1]
        k = bisect.bisect_right(large, capacity - a) - 1
        if k < 0:
            put(capacity - a, left.pop(a), [(a, 1)])
            large.pop()
            continue
        b = large[k]
        if a == b:
            many, odd = divmod(left.pop(a), 2)
            put(capacity - 2 * a, many, [(a, 2)])
            large.pop()
            if odd:  # one is left over; the next smaller may still join it
                partner = large[-1] if large else None
                if partner:
                    left[partner] -= 1
                    put(capacity - a - partner, 1, [(a, 1), (partner, 1)])
                    if not left[partner]:
                        left.pop(partner)
                        large.pop()
                else:
                    put(capacity - a, 1, [(a, 1)])
            continue
        many = min(left[a], left[b])
        put(capacity - a - b, many, [(a, 1), (b, 1)])
        for n in (a, b):
            left[n] -= many
            if not left[n]:
                left.pop(n)
                large.remove(n)
    for n in sorted(left, reverse=True):
        many = left.pop(n)
        while many:
            k = bisect.bisect_left(gaps, n)
            if k == len(gaps):
                each = min(many, capacity // n)
                put(capacity - each * n, many // each, [(n, each)])
                many -= many // each * each
                continue
            gap = gaps[k]
            have, items = bins[gap].pop()
            if not bins[gap]:
                del bins[gap]
                gaps.pop(k)
            each = min(gap // n, many)
            used = min(have, many // each)
            put(gap - each * n, used, [*items, (n, each)])
            put(gap, have - used, items)
            many -= used * each
    return [x for b in bins.values() for x in b]


def pack(docs: DataFrame, make_encoder=public_encoder, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of docs."""
    scratch = Scratch(docs.sparkSession)
    p = scratch.save(pieces(docs, make_encoder, capacity).withColumn("serial", F.monotonically_increasing_id()), "pieces")
    n = p.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity rows
    counts = {r["length"]: r["n"] for r in n}
    # For each length: first rank, how many sequences, first sequence, offset, of each pattern that uses it.
    runs: dict[int, list] = {}
    used: dict[int, int] = dict.fromkeys(counts, 0)
    sequence = 0
    for many, items in plan(counts, capacity):
        offset = 0
        for length, each in items:
            runs.setdefault(length, []).append((used[length], many, sequence, offset))
            used[length] += many * each
            offset += length * each
        sequence += many
    table = {k: np.array(v, np.int64).reshape(-1, 4) for k, v in runs.items()}
    buckets = docs.sparkSession.createDataFrame([(k, -(-n // RANK)) for k, n in counts.items()], "length long, buckets int")
    b = p.join(F.broadcast(buckets), "length")  # at most capacity rows
    b = b.withColumn("bucket", F.pmod(F.xxhash64("serial"), F.col("buckets")).cast("int")).drop("buckets")
    per = b.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("k"))
    before = per.select("length", "bucket", (F.sum("k").over(W.partitionBy("length").orderBy("bucket")) - F.col("k")).alias("before"))
    inside = F.row_number().over(W.partitionBy("length", "bucket").orderBy("serial")) - 1
    ranked = b.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if not len(part):
                    continue
                t, r = table[int(length[part[0]])], rank[part]
                at = t[np.searchsorted(t[:, 0], r, "right") - 1]
                turn = r - at[:, 0]
                seq[part] = at[:, 2] + turn % at[:, 1]
                off[part] = at[:, 3] + turn // at[:, 1] * length[part]
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
