"""Temperature mixing of sources, with DataFrame expressions only.

Source token shares p are raised to an exponent and normalised. The exponent is
bisected on aggregates of the source table until the weights reach a target
entropy, or until no document is repeated more often than a limit. Weights
become whole schedules: every row gets floor(r) copies, r being its source's
repetitions, and part of a (source, slice) gets one more, chosen in hash order
up to the slice's token budget. Copies are laid out in blocks: each slice
spreads its tokens evenly over all blocks, so every block holds the target mix,
and within a block copies stand in hash order.

The default budget is the least one under which every source is seen whole, so
no document is lost. A budget of tokens may be given; what the limit does not
allow of it is not spent: at most limit times the tokens there are.

Rows are scheduled one by one, in the order of a hash of what they hold, so the
same rows give the same schedule however they are stored. A row that repeats so
often that its hash would be a hot key is dealt out by a number that each
occurrence got when it was written.

Defined results: null source is a source of its own; a null text has no tokens
and is scheduled like others; rows that share a doc_id, or have none, are rows
like others; a target entropy that no exponent up to MOST reaches (below that of
equal largest sources, or above that of equal shares) gets the nearest one; an
empty table gives an empty result; other columns are ignored by the schedule and
kept by mix().
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import PARTS, Scratch, join_counted, words_of

REPEAT_LIMIT = 2.0
BLOCK_TOKENS = 1 << 20
BLOCK_DOCS = 1 << 16
SLICE_DOCS = 400
STEPS = 5  # bisection steps that one aggregate answers
MOST = 32.0  # the largest exponent


def _sources(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source_key").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))


def weights_at(sources: DataFrame, exponents: list[float], total: float) -> list:
    """For each exponent a row: sums z of q and e of q ln q, and the most and least of q / p, q being p to its power; nothing without tokens."""
    p = F.col("tokens") / F.lit(float(total))
    each = F.explode(F.lit(exponents).cast("array<double>")).alias("a")
    s = sources.filter("tokens > 0").select(p.alias("p"), each).withColumn("q", F.pow("p", "a"))
    aggs = [F.sum("q").alias("z"), F.sum(F.col("q") * F.log("q")).alias("e"), F.max(F.col("q") / F.col("p")).alias("hi"), F.min(F.col("q") / F.col("p")).alias("lo")]
    return s.groupBy("a").agg(*aggs).orderBy("a").collect()


def bisect_exponent(sources: DataFrame, total: float, target_entropy: float | None, repeat_limit: float, budget: float | None = None, rounds: int = 6) -> float:
    """The exponent, to within 2 ** -(rounds * STEPS) of the range that holds it.

    Entropy falls and repetitions fall as the exponent rises to 1, so both tests are
    monotone: the least exponent that keeps repetitions within the limit, or
    whose entropy is at most the target. 1 keeps the natural shares; only an
    entropy below theirs needs more. Without a budget the least-repeated source is seen once.
    """
    n = 1 << STEPS

    def fits(x) -> bool:
        if target_entropy is not None:
            return math.log(x["z"]) - x["e"] / x["z"] <= target_entropy
        if budget is not None:
            return x["hi"] / x["z"] * budget <= repeat_limit * total * (1 + 1e-9)
        return x["hi"] <= repeat_limit * x["lo"]

    lo, hi = 0.0, 1.0
    if target_entropy is not None:
        ends = [2.0**k for k in range(int(math.log2(MOST)) + 1)]
        x = weights_at(sources, ends, total)
        if not x:
            return 1.0
        first = next((k for k in range(len(ends)) if fits(x[k])), None)
        if first is None:
            return MOST
        lo, hi = (ends[first - 1] if first else 0.0), ends[first]
    for r in range(rounds):
        inner = [lo + (hi - lo) * k / n for k in range(n)]
        x = weights_at(sources, inner, total)
        if not x or (r == 0 and fits(x[0])):
            return lo
        first = next((k for k in range(1, n) if fits(x[k])), n)
        lo, hi = inner[first - 1], lo + (hi - lo) * first / n
    return hi


def _scheduled(docs: DataFrame, carry: list[str], scratch: Scratch, target_entropy: float | None, repeat_limit: float, budget: float | None, block_tokens: int, seed: int) -> tuple[DataFrame, int]:
    """The rows of docs (doc_id, source, text, carry) with row, u (hash of what it holds), source_key, n_tokens, weight, slice, copies; and the number of blocks."""
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    holds = F.xxhash64(F.col("doc_id"), key, F.col("text"), F.lit(seed)).alias("u")
    d = docs.select(*carry, F.monotonically_increasing_id().alias("row"), holds, key.alias("source_key"), F.size(words_of(F.col("text").cast("string"))).cast("long").alias("n_tokens"))
    d = scratch.save(d, "tokens")
    sources = scratch.save(_sources(d), "sources")
    total, rows = sources.agg(F.sum("tokens"), F.sum("n_docs")).first()
    total, rows = total or 0, rows or 0
    if budget is not None:
        budget = min(float(budget), repeat_limit * total)
    a = bisect_exponent(sources, total, target_entropy, repeat_limit, budget) if total else 1.0
    p = F.col("tokens") / F.lit(float(total or 1))
    one = F.pow(p, F.lit(1 - a))
    scale = sources.filter("tokens > 0").agg(F.sum(F.pow(p, F.lit(a))).alias("z"), F.max(one).alias("least"), F.min(one).alias("most")).first()
    z, least, most = scale["z"] or 1.0, scale["least"] or 1.0, scale["most"] or 1.0
    # repetitions = weight * budget / tokens; the default budget makes their minimum 1
    whole = budget is None
    if whole:
        budget = total * z * least
    if target_entropy is not None:  # its weights may repeat some source too often
        whole = whole and budget <= repeat_limit * total * z * most
        budget = min(budget, repeat_limit * total * z * most)
    reps = F.when(F.col("tokens") == 0, 1.0).otherwise(F.pow(p, F.lit(a)) / F.lit(z) * F.lit(float(budget)) / F.greatest("tokens", F.lit(1)))
    reps = F.round(F.greatest(reps, F.lit(1.0)) if whole else reps, 9)
    slices = F.ceil(F.col("n_docs") / SLICE_DOCS).cast("int").alias("slices")  # by source, so that the largest one's are no larger
    mix = sources.select("source_key", "n_docs", slices, reps.alias("reps"), F.when(F.col("tokens") > 0, F.pow(p, F.lit(a)) / F.lit(z)).otherwise(0.0).alias("weight"))
    blocks = max(1, math.ceil(budget / block_tokens), math.ceil(rows / BLOCK_DOCS))
    often = d.groupBy("u").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > max(SLICE_DOCS, rows / PARTS)).select("u", F.lit(True).alias("often"))
    d = join_counted(d, mix, "source_key", "n_docs").join(F.broadcast(often), "u", "left")  # fewer than PARTS rows
    dealt = F.xxhash64(F.col("u"), F.when(F.col("often"), F.col("row")), F.lit(seed + 1))
    d = d.withColumn("slice", F.pmod(dealt, F.col("slices"))).drop("often")
    cell = W.partitionBy("source_key", "slice")
    ordered = cell.orderBy("u", "row")
    before = F.sum("n_tokens").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    extra = (F.col("reps") - F.floor("reps")) * F.sum("n_tokens").over(cell)
    one_more = (F.coalesce(before, F.lit(0)) + F.col("n_tokens") / 2 <= extra) & (F.col("reps") > F.floor("reps"))
    d = d.withColumn("copies", F.floor("reps").cast("int") + F.when(one_more, 1).otherwise(0)).filter("copies > 0")
    return d, blocks


def schedule(
    docs: DataFrame, target_entropy: float | None = None, repeat_limit: float = REPEAT_LIMIT, budget: float | None = None,
    block_tokens: int = BLOCK_TOKENS, seed: int = 17,
) -> DataFrame:
    """Copies to train on: doc_id, source, n_tokens, copy, weight, block, place, row (the row of docs that a copy is of)."""
    scratch = Scratch(docs.sparkSession)
    d, blocks = _scheduled(docs.select("doc_id", "source", "text"), ["doc_id"], scratch, target_entropy, repeat_limit, budget, block_tokens, seed)
    c = d.select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    v = F.xxhash64(F.col("u"), F.col("copy"), F.lit(seed + 2))
    cell = W.partitionBy("source_key", "slice")
    done = F.coalesce(F.sum("n_tokens").over(cell.orderBy("copy", v, "row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    count = F.row_number().over(cell.orderBy("copy", v, "row")) - 1
    # a slice without tokens is spread by its rows
    all_, rows = F.sum("n_tokens").over(cell), F.count(F.lit(1)).over(cell)
    share = F.when(all_ > 0, (done + F.col("n_tokens") / 2) / all_).otherwise(count / rows)
    turn = F.pmod(F.xxhash64("source_key", "slice"), F.lit(blocks))
    c = c.withColumn("block", F.pmod(F.floor(share * blocks).cast("long") + turn, F.lit(blocks)))
    c = c.withColumn("place", F.row_number().over(W.partitionBy("block").orderBy(v, "row", "copy")) - 1)
    source = F.when(F.col("source_key") == "-", F.lit(None)).otherwise(F.substring("source_key", 2, 1 << 30))
    return c.select("doc_id", source.alias("source"), "n_tokens", "copy", "weight", "block", "place", "row")


def mix(docs: DataFrame, target_entropy: float | None = None, repeat_limit: float = REPEAT_LIMIT, budget: float | None = None, seed: int = 17) -> DataFrame:
    """The rows of docs, each as often as the schedule says; the same columns."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    d = docs.select("doc_id", "source", "text", *[docs[c].alias(n) for c, n in names.items()])
    d, _ = _scheduled(d, list(names.values()), Scratch(docs.sparkSession), target_entropy, repeat_limit, budget, BLOCK_TOKENS, seed)
    times = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return d.select(*[F.col(n) for n in names.values()], times.alias("_copy")).select(*[F.col(n).alias(c) for c, n in names.items()])
