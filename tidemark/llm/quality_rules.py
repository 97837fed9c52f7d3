"""Weak supervision of document quality with DataFrame expressions only.

Rules vote good (+1), bad (-1) or abstain (0). Documents are counted by vote
pattern, of which there are at most 3 ** len(RULES) whatever the corpus size;
expectation-maximisation over those counts, a few sums on the driver until
convergence, estimates how often each rule votes good, bad or not at all on good
and on bad documents, and the posterior of "good" decides.

Defined results: a null or empty text has no words and fails the base rules;
repeated rows each give a row; a null doc_id is kept as null; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, words_of

WINDOW = 8
ITERATIONS = 5000


def _features(docs: DataFrame) -> DataFrame:
    """Counts that the rules read. Row-local: no shuffle, no Python."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id"), text.alias("t"))
    d = d.select("doc_id", "t", words_of(F.col("t")).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length(F.regexp_replace("t", r"[^\p{Lu}]+", ""))).cast("long").alias("n_upper"),
        ((F.length("t") - F.length(F.replace("t", F.lit("!!"), F.lit("")))) / 2).cast("long").alias("n_shouts"),
        ((F.length("t") - F.length(F.replace("t", F.lit(" | "), F.lit("")))) / 3).cast("long").alias("n_cells"),
        lines.alias("l"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    n = F.size("h")
    wins = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    d = d.select(
        *[c for c in d.columns if c not in ("l", "h")],
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("h")).cast("long").alias("n_distinct"),
        wins.alias("v"),
    )
    # Only texts with a window that comes back sort (hash, place) pairs.
    pairs = F.array_sort(F.transform("v", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("s", F.when(F.size(F.array_distinct("v")) < F.size("v"), pairs)).drop("v")
    again = F.transform(
        "s",
        lambda x, k: F.when((x["h"] == F.get("s", k - 1)["h"]) | (x["h"] == F.get("s", k + 1)["h"]), x["i"]),
    )
    d = d.withColumn("p", F.when(F.col("s").isNotNull(), F.sort_array(F.filter(again, lambda x: x.isNotNull())))).drop("s")
    covered = F.aggregate(
        "p",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")),
    )["n"]
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("p")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


#: name -> (is bad, is good), over the columns of _features. A rule that is never a sign of good text has no second part.
RULES = {
    "length": ("n_words < 20", "n_words >= 50"),
    "symbols": ("10 * n_symbols > n_words", "false"),
    "lines": ("10 * n_dup_lines > 3 * n_lines", "false"),
    "repeats": ("100 * n_repeat_words > 20 * n_words", "false"),
    "word_length": ("word_chars > 12 * n_words or 2 * word_chars < 5 * n_words", "word_chars between 3 * n_words and 9 * n_words"),
    "capitals": ("10 * n_upper > 4 * word_chars", "false"),
    "shouting": ("10 * n_shouts > n_words", "false"),
    "cells": ("10 * n_cells > n_words", "false"),
    "variety": ("n_words >= 50 and 100 * n_distinct < 15 * n_words", "100 * n_distinct >= 25 * n_words"),
}

#: P(bad vote | good), P(bad vote | bad), P(good vote | good), P(good vote | bad) of every rule before the first step.
START = (0.002, 0.3, 0.9, 0.65)
#: What a rule is written for: it votes bad on no more than this share of good documents. Without such a bound a rule
#: whose faults no other rule sees would count as noise.
FALSE_ALARMS = 0.003


def _outcomes(rates: tuple[float, ...]) -> dict[int, float]:
    """Log of P(outcome | good) / P(outcome | bad) for a bad vote, an abstention and a good vote."""
    bad_good, bad_bad, good_good, good_bad = rates
    return {-1: math.log(bad_good / bad_bad), 0: math.log((1 - bad_good - good_good) / (1 - bad_bad - good_bad)), 1: math.log(good_good / good_bad)}


def _posterior(model: dict) -> Column:
    """Probability that a document with these votes is good, under the model."""
    out = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for r, rates in model["rules"].items():
        odds = _outcomes(rates)
        out = out + F.when(F.col(f"v_{r}") == 1, odds[1]).when(F.col(f"v_{r}") == -1, odds[-1]).otherwise(odds[0])
    return 1 / (1 + F.exp(-out))


def _ordered(high: tuple[float, float], low: tuple[float, float], most: float = 1.0) -> tuple[float, float]:
    """The likeliest rates of two counts (hits, tries), the first not below the second and the second not above most."""
    rate = lambda h, n: (h + 0.5) / (n + 1)
    a, b = rate(*high), rate(*low)
    if a < b:
        a = b = rate((high[0] + low[0]) / 2, (high[1] + low[1]) / 2)
        if b > most:
            a = max(rate(*high), most)
    return a, min(b, most)


def maximise(patterns: list[tuple[tuple[int, ...], int]], names: list[str], iterations: int = ITERATIONS) -> tuple[dict, list[float]]:
    """The model of greatest penalised likelihood found from START, and the likelihood after each step.

    A rule has three outcomes: it votes bad, or else good, or else abstains. Both
    steps are estimated for either class, with the only bounds that a bad document
    is no less likely to be voted bad, and no more likely to be voted good when it
    is not, and that of FALSE_ALARMS; half a document in one smooths. Each step raises the penalised
    likelihood; they end when a document's share of it rises by less than 1e-10.
    """
    model = {"prior": 0.8, "rules": dict.fromkeys(names, START)}
    total, path = sum(n for _, n in patterns), []
    if not total:
        return model, path
    for _ in range(iterations):
        tables = [({v: math.log(p) for v, p in ((-1, r[0]), (0, 1 - r[0] - r[2]), (1, r[2]))}, {v: math.log(p) for v, p in ((-1, r[1]), (0, 1 - r[1] - r[3]), (1, r[3]))}) for r in model["rules"].values()]
        lg, lb = math.log(model["prior"]), math.log(1 - model["prior"])
        seen = [{(v, c): 0.0 for v in (-1, 0, 1) for c in "gb"} for _ in names]
        good = likelihood = 0.0
        for votes, n in patterns:
            g = lg + sum(t[0][v] for t, v in zip(tables, votes, strict=True))
            b = lb + sum(t[1][v] for t, v in zip(tables, votes, strict=True))
            top = max(g, b)
            both = top + math.log(math.exp(g - top) + math.exp(b - top))
            likelihood += n * both
            share = n * math.exp(g - both)
            good += share
            for s, v in zip(seen, votes, strict=True):
                s[v, "g"] += share
                s[v, "b"] += n - share
        # what the half documents add, so that the whole rises with every step
        likelihood += math.log(model["prior"]) + math.log(1 - model["prior"])
        for r in model["rules"].values():
            for bad, up in ((r[0], r[2]), (r[1], r[3])):
                likelihood += 0.5 * (math.log(bad) + math.log(1 - bad) + math.log(up / (1 - bad)) + math.log(1 - up / (1 - bad)))
        path.append(likelihood)
        if len(path) > 1 and path[-1] - path[-2] < 1e-10 * total:
            break
        rules = {}
        for name, s in zip(names, seen, strict=True):
            n = {c: sum(s[v, c] for v in (-1, 0, 1)) for c in "gb"}
            bad_bad, bad_good = _ordered((s[-1, "b"], n["b"]), (s[-1, "g"], n["g"]), FALSE_ALARMS)
            up_good, up_bad = _ordered((s[1, "g"], n["g"] - s[-1, "g"]), (s[1, "b"], n["b"] - s[-1, "b"]))
            rules[name] = (bad_good, bad_bad, up_good * (1 - bad_good), up_bad * (1 - bad_bad))
        model = {"prior": (good + 1) / (total + 2), "rules": rules}
    return model, path


def fit(votes: DataFrame, iterations: int = ITERATIONS) -> dict:
    """The model of counted vote patterns (columns v_<rule>, n), of which there are 3 ** len(RULES) at most."""
    names = list(RULES)
    rows = votes.select(*[f"v_{r}" for r in names], "n").collect()
    return maximise([(tuple(x[:-1]), x[-1]) for x in rows], names, iterations)[0]


def quality_rules(docs: DataFrame, iterations: int = ITERATIONS, threshold: float = 0.5) -> DataFrame:
    """One row per row of docs (doc_id, text): counts, votes, posterior, base_failed, kept."""
    scratch = Scratch(docs.sparkSession)
    f = _features(docs)
    f = f.select("*", *[_vote(F.expr(b), F.expr(g)).alias(f"v_{r}") for r, (b, g) in RULES.items()])
    f = scratch.save(f, "features")
    model = fit(f.groupBy(*[f"v_{r}" for r in RULES]).agg(F.count(F.lit(1)).alias("n")), iterations)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return f.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (_posterior(model) >= threshold)).alias("kept"),
        _posterior(model).alias("posterior"),
        *[f"v_{r}" for r in RULES],
    )
