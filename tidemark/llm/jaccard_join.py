"""Grouped prefix join: exact Jaccard links between documents, and their components.

Rows are saved once with a key of their own, so rows that share a doc_id stay apart.

1. Every text becomes the set of 64-bit hashes of its distinct word shingles.
   A sketch counts shingles in 2 ** SKETCH_BITS buckets (a fixed size, whatever
   the corpus); (bucket count, hash) is the global order that puts rare shingles
   first. Any fixed order gives exact results, the sketch only makes it selective.
2. Documents with the same set collapse into one; documents with the same prefix
   and size collapse into one group, which is posted once per prefix shingle.
3. Group pairs that share a posting are filtered by size, by position, and by
   BITS parity bits, a lower bound of the sets' difference. First every group
   meets only the pivots of its posting lists and tries the nearest; links join
   components. Then groups are expanded, and a posting list pairs members of
   different components, the lesser ones against all; pairs that pass the filters
   are verified on whole sets. A list of N near copies so costs about N pairs, and
   still no link between components is missed. Keys that hold many pairs (a
   cluster's pivot, a hot posting list, a hub) are split: by salts, by blocks of
   one side, or by broadcasting the few hottest.
4. Components come from alternating large-star and small-star steps, which are
   joins and grouped minima; nothing is collected. They run until nothing changes.
5. Links are counted where they can be, inside components. The sets of a component
   are dealt to blocks of at most about BLOCK_SETS sets and BLOCK_HASHES hashes; a
   task meets two blocks, multiplies their incidence matrices and sends back one
   number a set, never a pair. A component of one block costs one copy of its sets;
   one of m blocks costs m, and the products grow with the square of its distinct sets.

Defined results: null, empty or wordless text has an empty set and no links;
fewer words than a shingle give one shingle of all words; every row has its own
set and links, and rows with words that share a doc_id belong together, so the
id has the links of all of them; a row without doc_id links like others, and its
component_id is the least doc_id it reaches, null if there is none; n_links
counts other rows with a set similar enough, so exact copies count and rows that
only share a doc_id do not; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_counted

SKETCH_BITS = 20
BITS = 512
ODD = [f"o{i}" for i in range(BITS // 64)]
PARTS = 64  # slices in which the sketch is summed
KINDS = 0x9E3779B97F4A7C15
HEAVY = 1 << 16  # at most twice as many rows are salted one by one
BLOCK_SETS = 2048  # sets of a component in a block, on average at most
BLOCK_HASHES = 1 << 17  # and hashes of those sets
LIST_BLOCK = 1024  # members of lesser components that one task meets of a list


class _Words(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, w: bytes) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, size: int, words: _Words) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text in UTF-8."""
    w = (text or b"").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    k = min(size, len(w))
    out = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(KINDS) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _sketch(docs: DataFrame, size: int) -> np.ndarray:
    """Bucket counts of all documents' shingles, as 32-bit numbers."""

    def count(batches):
        words, total = _Words(), np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            for t in _texts(b):
                np.add.at(total, (shingles(t, size, words) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        parts = np.minimum(total, 2**16 - 1).astype("<u2").reshape(PARTS, -1)  # a task's counts may stop there: the order stays one order
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "counts"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for p, c in zip(b.column("part").to_pylist(), b.column("counts").to_pylist(), strict=True):
                x = np.frombuffer(c, "<u2").astype(np.int64)
                held[p] = held[p] + x if p in held else x
        for p, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype("<u4").tobytes()], pa.binary())], ["part", "counts"])

    kind = "part int, counts binary"
    rows = docs.select("text").mapInArrow(count, kind).repartition(PARTS, "part").mapInArrow(add, kind).collect()  # 4 MB
    out = np.zeros((PARTS, (1 << SKETCH_BITS) // PARTS), np.uint32)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["counts"], "<u4")
    return out.reshape(-1)


def _rows(batches, names: list[str], types: list[pa.DataType], make):
    """One output batch for each input batch, from make(batch) -> columns."""
    for b in batches:
        cols = make(b)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _prefixes(docs: DataFrame, size: int, percent: int, sketch) -> DataFrame:
    """r, doc_id, n, whole (digest of the set), lead (digest of prefix and size), prefix in the global order, and ODD.

    ODD are BITS bits: whether the set has an odd number of hashes in each of
    BITS classes. Two sets differ in at least as many elements as their bits do.
    """
    import hashlib

    def run(batches):
        words, counts = _Words(), sketch.value

        def make(b):
            n, whole, lead, prefix = [], [], [], []
            odd = np.zeros((b.num_rows, BITS), np.uint8)
            for r, t in enumerate(_texts(b)):
                s = shingles(t, size, words)
                odd[r] = np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
                n.append(len(s))
                whole.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keep = len(s) - (percent * len(s) + 99) // 100 + 1 if len(s) else 0
                rare = counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                p = s[np.lexsort((s, rare))[:keep]]
                prefix.append(p.view(np.int64))
                lead.append(hashlib.blake2b(p.tobytes() + len(s).to_bytes(8, "little"), digest_size=16).digest())
            packed = np.packbits(odd, axis=1).view(np.int64)
            return [b.column("r"), b.column("doc_id"), n, whole, lead, prefix, *packed.T.copy()]

        types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())] + [pa.int64()] * len(ODD)
        yield from _rows(batches, ["r", "doc_id", "n", "whole", "lead", "prefix", *ODD], types, make)

    return docs.select("r", "doc_id", "text").mapInArrow(run, "r long, doc_id long, n int, whole binary, lead binary, prefix array<long>, " + ", ".join(f"{c} long" for c in ODD))


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """r, salt, s: the whole sorted set of each row that wanted (r, salts) asks for, once for each salt."""

    def run(batches):
        words = _Words()
        for big in batches:
            for at in range(0, big.num_rows, 64):
                b = big.slice(at, 64)
                for r, salts, t in zip(b.column("r").to_pylist(), b.column("salts").to_pylist(), _texts(b), strict=True):
                    s = shingles(t, size, words).tobytes()
                    for k in range(0, len(salts), 64):
                        part = salts[k : k + 64]
                        yield pa.RecordBatch.from_arrays([pa.array([r] * len(part), pa.int64()), pa.array(part, pa.int32()), pa.array([s] * len(part), pa.binary())], ["r", "salt", "s"])

    return docs.select("r", "text").join(wanted, "r").mapInArrow(run, "r long, salt int, s binary")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of rows whose whole sets are similar enough.

    A row in many pairs is salted, so that no task meets all its partners' sets: of n
    pairs, those of a heavy row are dealt to about sqrt(n) tasks, each with a copy of its set.
    """
    pairs = scratch.save(pairs, "pairs")
    n = pairs.count()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("r"))
    heavy = scratch.save(ends.groupBy("r").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > max(64, n / HEAVY)).select("r"), "heavy")
    salts = max(1, math.ceil(math.sqrt(n)))

    def salted(p: DataFrame, end: str, other: str) -> DataFrame:
        flag = F.broadcast(heavy.select(F.col("r").alias(end), F.lit(True).alias("_h")))  # 2 * HEAVY rows at most
        salt = F.when(F.col("_h"), F.pmod(F.xxhash64(other), F.lit(salts))).otherwise(0).cast("int")
        return p.join(flag, end, "left").withColumn(f"salt_{end}", salt).drop("_h")

    p = salted(salted(pairs, "a", "b"), "b", "a")
    wanted = p.select(F.explode(F.array(F.struct(F.col("a").alias("r"), F.col("salt_a").alias("salt")), F.struct(F.col("b").alias("r"), F.col("salt_b").alias("salt")))).alias("x")).select("x.*")
    wanted = wanted.groupBy("r").agg(F.collect_set("salt").alias("salts"))  # sqrt(n) at most
    sets = scratch.save(_sets(docs, wanted, size), "sets")
    x = p.join(sets.select(F.col("r").alias("a"), F.col("salt").alias("salt_a"), F.col("s").alias("sa")), ["a", "salt_a"])
    x = x.join(sets.select(F.col("r").alias("b"), F.col("salt").alias("salt_b"), F.col("s").alias("sb")), ["b", "salt_b"]).select("a", "b", "sa", "sb")

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                keep = []
                for p, q in zip(b.column("sa"), b.column("sb"), strict=True):
                    p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                    small, large = (p, q) if len(p) <= len(q) else (q, p)
                    at_ = np.searchsorted(large, small)
                    both = int((large[np.minimum(at_, len(large) - 1)] == small).sum()) if len(small) else 0
                    keep.append(100 * both >= percent * (len(p) + len(q) - both) and both > 0)
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = scratch.save(x.mapInArrow(run, "a long, b long"), "links")
    scratch.drop(pairs, heavy, sets)
    return links


def shared_hashes(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of x with each of y."""
    out = np.zeros((len(x), len(y)), np.float32)
    u, at = np.unique(np.concatenate(x + y), return_inverse=True)
    own = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in x + y])
    left = own < len(x)
    both = (np.bincount(at[left], minlength=len(u)) > 0) & (np.bincount(at[~left], minlength=len(u)) > 0)
    column = np.cumsum(both) - 1
    kept = both[at]
    at, own = column[at[kept]], own[kept]
    order = np.argsort(at, kind="stable")
    at, own = at[order], own[order]
    for first in range(0, int(both.sum()), 2048):
        lo, hi = np.searchsorted(at, (first, first + 2048))
        m = np.zeros((len(x) + len(y), 2048), np.float32)
        m[own[lo:hi], at[lo:hi] - first] = 1
        out += m[: len(x)] @ m[len(x) :].T
    return out


def _link_counts(docs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """rep, links (rows of other sets similar enough) of nodes (rep, component, n, rows), exact within each component."""
    shape = nodes.groupBy("component").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_HASHES), F.ceil(F.count(F.lit(1)) / BLOCK_SETS)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("k"))
    wanted = join_counted(nodes.select("rep", "component", "rows"), shape, "component", "k")
    wanted = wanted.select(F.col("rep").alias("r"), "component", "rows", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"))
    kind = "component long, lo int, hi int, block int, rep long, rows long, s binary"
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in kind.split(", ")]

    def spread(batches):
        words = _Words()
        for big in batches:
            for at in range(0, big.num_rows, 64):
                b = big.slice(at, 64)
                for c, m, k, r, rows, t in zip(*(b.column(i).to_pylist() for i in ("component", "blocks", "block", "r", "rows")), _texts(b), strict=True):
                    s = shingles(t, size, words).tobytes()
                    for other in range(0, m, 64):
                        part = range(other, min(m, other + 64))
                        cols = [[c] * len(part), [min(k, o) for o in part], [max(k, o) for o in part], [k] * len(part), [r] * len(part), [rows] * len(part), [s] * len(part)]
                        yield pa.RecordBatch.from_arrays([pa.array(v, t_) for v, t_ in zip(cols, types, strict=True)], names)

    def count(table: pa.Table) -> pa.Table:
        block, lo, hi = table.column("block").to_numpy(), table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("s")]
        reps, rows = table.column("rep").to_numpy(), table.column("rows").to_numpy()
        sides = [np.flatnonzero(block == b) for b in (lo, hi)]
        links = np.zeros(len(sets), np.int64)
        if all(len(x) for x in sides):
            n = np.array([len(s) for s in sets], np.int64)
            p, q = sides
            both = shared_hashes([sets[i] for i in p], [sets[i] for i in q]).astype(np.int64)
            near = (both > 0) & (100 * both >= percent * (n[p][:, None] + n[q] - both)) & (reps[p][:, None] != reps[q])
            links[p] += near @ rows[q]
            if lo != hi:
                links[q] += near.T @ rows[p]
        return pa.table({"rep": pa.array(reps, pa.int64()), "links": pa.array(links, pa.int64())})

    sets = docs.select("r", "text").join(wanted, "r").mapInArrow(spread, kind)
    return sets.groupBy("component", "lo", "hi").applyInArrow(count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the least node reachable), for every node of edges (a, b) but the least of each component."""
    e = scratch.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def meet(rows: DataFrame, least: DataFrame) -> DataFrame:
        """rows joined to least on u, hubs apart where there are any."""
        return rows.join(least.drop("k"), "u") if n <= 8 * LIST_BLOCK else join_counted(rows, least, "u", "k", max(2 * n / 1024, LIST_BLOCK))

    n, mark, turn = e.count(), None, 0
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")).select("u", F.least("u", "m").alias("m"), "k")
        large = meet(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        top = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k"))
        small = meet(large, top).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        new = scratch.save(small.select("x.u", "x.v").filter("u <> v").distinct(), "edges")
        scratch.drop(e)
        e = new
        x = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (x["n"], x["h"]) == mark:
            return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        n, mark, turn = x["n"], (x["n"], x["h"]), turn + 1
        if turn > 500:  # the steps end after about the square of the number's logarithm
            raise RuntimeError("components do not settle")


def _labels(docs: DataFrame, size: int, percent: int, scratch: Scratch, count: bool = False) -> DataFrame:
    """r, doc_id, n, label (of the component), component_id, n_links (null unless asked to count) for every row of docs (r, doc_id, text), a saved table."""
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(_sketch(docs, size))
    all_ = scratch.save(_prefixes(docs, size, percent, sketch), "prefixes")
    # Same set: one row stands for all. Same prefix and size: one posts for all.
    firsts = all_.filter("n > 0").groupBy("n", "whole", "lead").agg(F.min("r").alias("rep"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    firsts = scratch.save(firsts, "firsts")
    groups = firsts.groupBy("n", "lead").agg(F.min("rep").alias("g"), F.count(F.lit(1)).alias("members"))
    member = firsts.join(groups.filter("members > 1").select("n", "lead", "g"), ["n", "lead"], "left").select("rep", F.coalesce("g", "rep").alias("g"), "n")
    member = scratch.save(member.join(all_.select(F.col("r").alias("rep"), *ODD), "rep"), "members")
    leads = groups.select(F.col("g").alias("r"), "members")
    reps = scratch.save(all_.select("r", "n", "prefix").join(leads, "r"), "reps")
    size_at = (F.col("n").cast("long") * (1 << 32)).alias("size")
    posts = reps.select(F.col("r").alias("g"), "members", size_at, F.posexplode("prefix").alias("at", "token"))
    # Only lists that could hold a link: two members or more. Saved, so that the join below can be split where a list is hot.
    lists = scratch.save(posts.groupBy("token").agg(F.sum("members").alias("len")).filter("len > 1"), "lists")
    shared = posts.select("token", "g", (F.col("size") + F.col("at")).alias("na")).join(lists, "token")
    shared = shared.select("token", "g", "len", F.shiftright("na", 32).cast("int").alias("n"), F.col("na").bitwiseAND((1 << 32) - 1).cast("int").alias("at"))
    shared = scratch.save(shared, "shared")
    scratch.drop(reps, lists)

    def sizes(n1: Column, at1: Column, n2: Column, at2: Column) -> Column:
        """Size and position filters: what must hold if the sets are similar enough."""
        left = F.least(n1 - at1, n2 - at2)
        return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & ((100 + percent) * left.cast("long") >= percent * (n1 + n2))

    def bits_near(x: str, y: str) -> Column:
        """The same for the bits."""
        return (100 + percent) * apart(x, y) <= (100 - percent) * (F.col(f"{x}.n") + F.col(f"{y}.n"))

    def apart(x: str, y: str) -> Column:
        out = F.lit(0)
        for c in ODD:
            out = out + F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")))
        return out

    # Round one: every group meets the most central member of its lists, the one in most company, and of
    # those it tries the nearest by bits; other members try the first of their group.
    company = shared.groupBy("g").agg(F.sum("len").alias("company"))
    x = shared.join(company, "g")
    pivots = x.groupBy("token").agg(F.max(F.struct("company", "g", "n", "at")).alias("p"))
    pivots = scratch.save(pivots.select("token", F.col("p.g").alias("pg"), F.col("p.n").alias("pn"), F.col("p.at").alias("pat")), "pivots")
    met = shared.join(pivots, "token").filter((F.col("g") != F.col("pg")) & sizes(F.col("n"), F.col("at"), F.col("pn"), F.col("pat")))
    met = met.select(F.col("g").alias("ag"), F.col("pg").alias("bg")).distinct()
    of_group = member.select("rep", "n", *ODD)
    met = met.join(of_group.alias("a"), F.col("ag") == F.col("a.rep")).join(of_group.alias("b"), F.col("bg") == F.col("b.rep")).filter(bits_near("a", "b"))
    best = met.groupBy(F.col("ag").alias("a")).agg(F.min(F.struct(apart("a", "b").alias("d"), F.col("bg").alias("b"))).alias("s")).select("a", "s.b")
    inner = member.filter("rep <> g").select(F.col("rep").alias("a"), F.col("g").alias("b"))
    links = _verified(best.union(inner), docs, size, percent, scratch)
    scratch.drop(pivots)
    similar = links
    # Sets of rows with one doc_id belong together.
    named = all_.filter("n > 0 and doc_id is not null").withColumn("w", F.xxhash64("n", "whole"))
    several = named.groupBy("doc_id").agg(F.min("w").alias("lo"), F.max("w").alias("hi")).filter("lo <> hi").select("doc_id")
    several = scratch.save(several, "several")
    if not several.isEmpty():
        own = named.select("doc_id", "n", "whole").join(several, "doc_id").distinct().join(firsts.select("n", "whole", "rep"), ["n", "whole"]).select("doc_id", "rep")
        own = scratch.save(own, "own")
        links = links.union(join_counted(own, own.groupBy("doc_id").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("k")), "doc_id", "k").select(F.col("rep").alias("a"), "b"))
    comp = scratch.save(components(links, scratch), "components")
    # Round two: every member of a list of several components meets those of others, the lesser components
    # each of the others, the main one none of its own. No candidate is left out.
    m = member.join(comp, member["rep"] == comp["node"], "left").select("rep", "g", F.coalesce("component", "rep").alias("c"), *ODD)
    kinds = shared.join(m.select("g", "c"), "g").groupBy("token", "c").agg(F.count(F.lit(1)).alias("k"))
    main = kinds.groupBy("token").agg(F.max(F.struct("k", "c")).alias("main"), F.sum("k").alias("all"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    main = scratch.save(main.select("token", F.col("main.c").alias("main"), F.ceil((F.col("all") - F.col("main.k")) / LIST_BLOCK).cast("int").alias("blocks")), "main")
    x = scratch.save(shared.join(main, "token").join(m, "g").select("token", "rep", "n", "at", "c", "main", "blocks", *ODD), "open")
    # A long list is dealt out: its lesser members in blocks, each block meeting all.
    few = x.filter("c <> main").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).alias("f")
    many = x.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("m")
    # Two that are both of lesser components would meet from both sides; one side is enough.
    cross = (F.col("f.token") == F.col("m.token")) & (F.col("f.block") == F.col("m.block")) & (F.col("f.c") != F.col("m.c")) & ((F.col("m.c") == F.col("m.main")) | (F.col("f.rep") > F.col("m.rep")))
    near = sizes(F.col("f.n"), F.col("f.at"), F.col("m.n"), F.col("m.at")) & bits_near("f", "m")
    pairs = few.join(many, cross & near).select(F.greatest("f.rep", "m.rep").alias("a"), F.least("f.rep", "m.rep").alias("b")).distinct()
    found = _verified(pairs, docs, size, percent, scratch)
    comp = components(links.union(found), scratch)
    comp = comp.union(comp.select("component", "component").distinct())  # the least node is its own
    comp = scratch.save(comp, "components")
    scratch.drop(x, main, shared, member)
    ends = comp.join(firsts.select(F.col("rep").alias("node"), "least", "n", "rows"), "node")
    least = ends.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("k"), F.sum("rows").alias("all"))
    ends = scratch.save(join_counted(ends, least.withColumn("sets", F.col("k")), "component", "k"), "components")
    links_ = ends.select("node", F.lit(None).cast("long").alias("links"))
    if count:
        # Of two sets it is known whether they link; more are counted.
        pair = similar.union(found).select(F.explode(F.array("a", "b")).alias("node")).distinct()
        two = ends.filter("sets = 2").join(pair, "node").select("node", (F.col("all") - F.col("rows")).alias("links"))
        more = ends.filter("sets > 2").select(F.col("node").alias("rep"), "component", "n", "rows")
        links_ = two.union(_link_counts(docs, more, size, percent))
    comp = ends.select("node", "component", "component_id").join(links_, "node", "left")
    known = firsts.join(comp, F.col("rep") == F.col("node"), "left").select(
        "n", "whole", "rows", F.coalesce("component", "rep").alias("label"), F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("rows") - 1 + F.coalesce("links", F.lit(0)) if count else F.lit(None)).cast("long").alias("n_links"),
    )
    known = scratch.save(known, "known")
    out = ["r", "doc_id", "n", "label", "component_id", "n_links"]
    rows = join_counted(all_.filter("n > 0").select("r", "doc_id", "n", "whole"), known, ["n", "whole"], "rows").select(*out)
    return rows.unionByName(all_.filter("n = 0").select("r", "doc_id", "n", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id"), F.lit(0 if count else None).cast("long").alias("n_links")))


def _keyed(docs: DataFrame, scratch: Scratch, *carry: Column) -> DataFrame:
    """docs saved with a key r of each row."""
    return scratch.save(docs.select(F.monotonically_increasing_id().alias("r"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry), "rows")


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (other rows that it links with) for every row of docs."""
    scratch = Scratch(docs.sparkSession)
    return _labels(_keyed(docs, scratch), size, percent, scratch, count=True).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "n_links")


def keep_first(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """One row of docs of each component: that of the least doc_id (a missing one comes last), then the first row; wordless rows stay."""
    scratch = Scratch(docs.sparkSession)
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = _keyed(docs, scratch, *[docs[c].alias(n) for c, n in names.items()])
    part = scratch.save(_labels(rows, size, percent, scratch).filter("label is not null"), "labels")
    first = part.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "r")).alias("x"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    late = join_counted(part.select("label", "r"), first.select("label", F.col("x.r").alias("kept"), "k"), "label", "k").filter("r <> kept").select("r")
    return rows.join(late, "r", "left_anti").select(*[F.col(n).alias(c) for c, n in names.items()])
