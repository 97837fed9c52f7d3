"""Operators on small tables against brute force, with nulls, empty and long texts, ties and repeated rows."""

import collections
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, langid, lm, mixing, packing, quality_rules, site_quality, span_dedup, topk, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
R = np.random.default_rng(11)
VOCAB = ["the", "of", "and", "in", "a", *["".join(R.choice(list("abcdefgh"), 5)) for _ in range(300)]]


def prose(n, seed=None):
    r = np.random.default_rng(seed) if seed is not None else R
    w = [VOCAB[int(i)] for i in np.minimum(r.geometric(0.02, n) - 1, len(VOCAB) - 1)]
    return " ".join(x + ("." if k % 7 == 6 else "") + ("\n" if k % 23 == 22 else "") for k, x in enumerate(w))


BASE = prose(120, 1)


def edited(text, places, r):
    w = text.split()
    for p in places:
        w[p] = "x" + "".join(r.choice(list("pqrst"), 6))
    return " ".join(w)


def texts():
    r = np.random.default_rng(4)
    out = [None, "", " \t\n", "one", "ONE", "one two three", "One  two\nthree", "word " * 400, "ünïcode naïve\x0bvertical", "<|endoftext|> $$ ## |"]
    out += [BASE, BASE, BASE.upper(), BASE + " tail"]
    out += [edited(BASE, r.choice(100, int(k), replace=False), r) for k in r.integers(1, 8, 40)]
    out += [prose(int(n), int(n)) for n in r.integers(5, 200, 60)]
    out += [prose(60, 900 + k) + "\n" + BASE[:500] + "\n" + prose(40, 950 + k) for k in range(4)]
    out += [prose(9000, 77)]
    return out


TEXTS = texts()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, h long, token long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], "hot" if i % 3 else f"s{i % 4}", len(t or ""), 1, 2, 3) for i, t in enumerate(TEXTS)]
    rows.append((None, "no id at all", None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 > 0), int(i % 6 == 0)) for i in range(len(TEXTS))] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def held(i, m, k):
    return i is not None and zlib.crc32(str(i).encode()) % m == k


def all_rows():
    return [*enumerate(TEXTS), (None, "no id at all")]


# Quality rules


def rule_counts(t):
    t = t or ""
    w, at = WORD.findall(t), collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, empty):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert len(got) == len(all_rows())
    for i, t in all_rows():
        r, want = got[i], rule_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])
        assert 0 <= r["posterior"] <= 1
    assert got[10]["kept"]
    assert quality_rules.quality_rules(empty).count() == 0


def test_expectation_maximisation_finds_the_reliable_rule(spark):
    r = np.random.default_rng(1)
    rows = []
    for _ in range(3000):
        good = r.random() < 0.8
        votes = dict.fromkeys(quality_rules.RULES, 0)
        for k, name in enumerate(quality_rules.RULES):
            if good:
                votes[name] = 1 if r.random() < 0.8 else 0
            else:
                votes[name] = -1 if r.random() < (0.7 if k < 4 else 0.1) else 0
        rows.append(tuple(votes.values()))
    df = pd.DataFrame(rows, columns=[f"v_{k}" for k in quality_rules.RULES]).assign(n=1)
    m = quality_rules.fit(spark.createDataFrame(df))
    rates = [m["rules"][k][1] for k in quality_rules.RULES]
    assert m["prior"] == pytest.approx(0.8, abs=0.05)
    assert min(rates[:4]) > 0.55 and max(rates[4:]) < 0.25


def test_every_step_raises_the_likelihood():
    r = np.random.default_rng(2)
    names = list(quality_rules.RULES)
    for _ in range(5):
        patterns = [(tuple(int(v) for v in r.integers(-1, 2, len(names))), int(r.integers(1, 500))) for _ in range(60)]
        model, path = quality_rules.maximise(patterns, names)
        assert len(path) < quality_rules.ITERATIONS
        assert min(np.diff(path)) > -1e-6 * sum(n for _, n in patterns)
        assert all(x[0] <= min(x[1], quality_rules.FALSE_ALARMS) + 1e-12 and 0 < x[2] < 1 - x[0] for x in model["rules"].values())
    assert quality_rules.maximise([], names)[0]["prior"] == 0.8


def test_posterior_is_that_of_the_model(docs):
    """Every row's posterior and verdict from a plain evaluation of the model fitted to all rows' votes."""
    got = quality_rules.quality_rules(docs).toPandas()
    names = list(quality_rules.RULES)
    votes = [tuple(int(got[f"v_{k}"][i]) for k in names) for i in range(len(got))]
    model, _ = quality_rules.maximise(list(collections.Counter(votes).items()), names)
    for i, v in enumerate(votes):
        good, bad = model["prior"], 1 - model["prior"]
        for k, x in zip(names, v, strict=True):
            bg, bb, gg, gb = model["rules"][k]
            good, bad = good * {-1: bg, 0: 1 - bg - gg, 1: gg}[x], bad * {-1: bb, 0: 1 - bb - gb, 1: gb}[x]
        assert got.posterior[i] == pytest.approx(good / (good + bad), rel=1e-6)
        assert got.kept[i] == (not got.base_failed[i] and got.posterior[i] >= 0.5)


# Jaccard join


def shingle_set(t, size):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def jaccard_brute(size, percent):
    sets = {i: shingle_set(t, size) for i, t in enumerate(TEXTS)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (4, 60)])
def test_jaccard_components(docs, size, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_components(docs, size, percent).collect()}
    assert got.pop(None)[1:] == (None, 0)
    links = link_counts([shingle_set(t, size) for t in TEXTS], percent)
    assert max(links) > 5
    assert got == {i: (*x, links[i]) for i, x in jaccard_brute(size, percent).items()}


def link_counts(sets, percent=85):
    """Links of each set to the others, one by one."""
    out = [0] * len(sets)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            out[i] += i != j and bool(x & y) and 100 * len(x & y) >= percent * len(x | y)
    return out


def test_jaccard_links_counted_across_blocks(spark, monkeypatch):
    """A component cut into many blocks, long sets among short ones, copies of some, and blocks that stay empty."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 7)
    monkeypatch.setattr(jaccard_join, "BLOCK_HASHES", 1500)
    r = np.random.default_rng(8)
    rows = [edited(BASE, r.choice(100, int(k), replace=False), r) for k in r.integers(1, 5, 45)]
    rows += rows[:5] + rows[:2]
    long = prose(5000, 5)
    rows += [long + f" end{i}" for i in range(4)] + [None, "", "alone here among them all"]
    want = link_counts([shingle_set(t, 4) for t in rows])
    got = jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)).collect()
    assert {x["doc_id"]: x["n_links"] for x in got} == dict(enumerate(want))


def test_shared_hashes():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 6000, int(n)).astype(np.uint64)) for n in (0, 1, 50, 4000, 5000, 300)]
    got = jaccard_join.shared_hashes(sets[:3], sets[3:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[3:]] for a in sets[:3]]


def test_jaccard_edges(spark, docs, empty):
    assert jaccard_join.jaccard_components(empty).count() == 0
    twice = spark.createDataFrame([(1, BASE), (1, BASE), (2, BASE)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(twice).collect()) == [(1, 1), (1, 1), (2, 1)]
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    firsts = {i for i, (_, c) in jaccard_brute(4, 85).items() if i == c}
    assert {r["doc_id"] for r in kept.collect()} == firsts | {None}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_rows_that_share_an_id(spark, seed):
    """Ids with two rows of unlike texts, each with near copies elsewhere, rows without id, and exact copies of all of them."""
    r = np.random.default_rng(seed)
    rows = []
    for i in range(12):
        for half in (0, 1):
            t = prose(60, 10_000 * seed + 2 * i + half)
            rows += [(100 + i, t), (int(r.integers(200, 10_000)), edited(t, [int(r.integers(55))], r)), (int(r.integers(200, 10_000)), t)]
    lone = prose(60, 77 * seed)
    rows += [(None, lone), (50_000, edited(lone, [3], r)), (None, "none like it at all here"), (100, ""), (100, None), (7, ""), rows[0], rows[0]]
    sets = [shingle_set(t, 4) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = sets[i] and sets[j] and rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same or (both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    reach = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        reach[find(k)].append(i)
    links = link_counts(sets)
    want = [(i, len(sets[k]), min((x for x in reach[find(k)] if x is not None), default=None), links[k]) for k, (i, _) in enumerate(rows)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(x["doc_id"], x["n_shingles"], x["component_id"], x["n_links"]) for x in jaccard_join.jaccard_components(d).collect()]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = jaccard_join.keep_first(d.withColumn("r", F.lit(1)).withColumn("_c0", F.lit(2)))
    assert kept.columns == ["doc_id", "text", "r", "_c0"]
    groups = len({find(k) for k in range(len(rows)) if sets[k]}) + sum(not x for x in sets)
    assert kept.count() == groups


def test_jaccard_heavy_rows_and_long_lists_are_split(spark, monkeypatch):
    """A cluster around one text, and many texts that share a passage and are not alike, with small bounds of the splits."""
    monkeypatch.setattr(jaccard_join, "HEAVY", 1)
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 8)
    r = np.random.default_rng(3)
    passage = prose(70, 31)
    rows = [edited(BASE, r.choice(100, int(r.integers(1, 4)), replace=False), r) for _ in range(150)]
    rows += [passage + " " + " ".join("".join(r.choice(list("uvwxyz"), 6)) for _ in range(14)) for _ in range(40)]
    sets = [shingle_set(t, 4) for t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {x["doc_id"]: x["component_id"] for x in jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def test_components_of_a_long_chain(spark):
    from tidemark.llm.common import Scratch

    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["component"] for r in jaccard_join.components(edges, Scratch(spark)).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and got[501] == 500


# Site quality


def test_site_quality(spark, docs, empty, labels):
    d = docs.select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    got = site_quality.site_quality(d, labels).collect()
    assert len(got) == len(all_rows())
    assert all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert not by[0]["kept"] and by[0]["own"] is None
    assert site_quality.site_quality(empty.select("doc_id", "text", F.lit("h").alias("host"), F.lit("p").alias("path")), labels).count() == 0
    none = site_quality.site_quality(d, labels.limit(0)).collect()
    assert {r["own"] for r in none} <= {0.0, None}


def test_sparse_sites_shrink(spark):
    junk = lambda: " ".join(f"$$$ ### {x}" for x in range(30))
    rows, lab = [], []
    for i in range(600):
        bad = i % 4 == 0 if i < 300 else i % 40 == 0
        rows.append((i, junk() if bad else prose(60), "big_bad" if i < 300 else "big_good", "p"))
        lab.append((i, int(not bad)))
    rows.append((1000, prose(60), "tiny", "p"))
    s = site_quality.site_quality(spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), spark.createDataFrame(lab, "doc_id long, quality int"))
    share = {x["doc_id"]: x for x in s.collect()}
    assert share[1]["host_share"] < share[1000]["host_share"] < share[301]["host_share"]
    assert share[1]["kept"] and not share[0]["kept"]


def strength_brute(groups):
    """Pseudo-count by moments of groups (n, good, mean)."""
    g = [x for x in groups if x[0] > 0]
    spread = sum(n * (k / n - m) ** 2 for n, k, m in g)
    chance, room = sum(m * (1 - m) for _, _, m in g), sum((n - 1) * m * (1 - m) for n, _, m in g)
    if room <= 0:
        return 10.0
    rho = (spread - chance) / room
    return min(1e4, max(1.0, 1 / rho - 1)) if rho > 0 else 1e4


def test_site_quality_against_brute_force(spark):
    """Shares and scores from the own evidence, each row left out of its site; null hosts, repeated rows and sites of one row among them."""
    r = np.random.default_rng(12)
    junk = lambda k: " ".join(f"$$$ ### {x}" for x in r.integers(0, 99, k))
    rows, lab = [], []
    for i in range(400):
        bad = r.random() < (0.7 if i % 5 == 0 else 0.1)
        host = None if i % 7 == 0 else f"h{i % 5}" if i < 380 else f"lone{i}"
        rows.append((i, junk(30) if bad else prose(60, 5000 + i), host, None if i % 11 == 0 else f"p{i % 3}", 1.0, 2))
        lab.append((i, int(not bad)))
    rows += [rows[3], rows[3], (500, None, "h1", "p1", 1.0, 2), (501, " ", "new", "p", 1.0, 2), (None, prose(50, 1), "h2", "p0", 1.0, 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, host string, path string, own double, n int")
    got = site_quality.site_quality(d, spark.createDataFrame(lab, "doc_id long, quality int")).toPandas()
    assert len(got) == len(rows)
    own = {None if pd.isna(a) else int(a): None if pd.isna(b) else b for a, b in zip(got.doc_id, got.own, strict=True)}
    step = site_quality.STEP
    bins = collections.Counter(math.floor(abs(own[x[0]]) / step + 0.5) * (1 if own[x[0]] > 0 else -1) for x in rows if own[x[0]] is not None)
    p = 0.5
    for _ in range(3000):
        p = (sum(n / (1 + math.exp(-k * step) * (1 - p) / p) for k, n in bins.items()) + 0.5) / (sum(bins.values()) + 1)
    good = {i: 0.0 if z is None else 1 / (1 + math.exp(-z) * (1 - p) / p) for i, z in own.items()}
    one = {i: int(z is not None) for i, z in own.items()}
    hosts, paths = collections.defaultdict(lambda: [0, 0.0]), collections.defaultdict(lambda: [0, 0.0])
    for i, _, h, q, *_ in rows:
        for s in (hosts[h], paths[h, q]):
            s[0] += one[i]
            s[1] += good[i]
    kh = strength_brute([(n, g, p) for n, g in hosts.values()])
    kp = strength_brute([(n, g, (hosts[h][1] + kh * p) / (hosts[h][0] + kh)) for (h, _), (n, g) in paths.items()])
    by = {None if pd.isna(x.doc_id) else int(x.doc_id): x for x in got.itertuples()}
    for i, _, h, q, *_ in rows:
        hs = max(hosts[h][1] - good[i] + kh * p, 0) / (hosts[h][0] - one[i] + kh)
        ps = max(paths[h, q][1] - good[i] + kp * hs, 0) / (paths[h, q][0] - one[i] + kp)
        score = 1 / (1 + math.exp(-(own[i] or 0.0)) * (1 - ps) / ps)
        assert (by[i].host_share, by[i].path_share, by[i].score) == pytest.approx((hs, ps, score), rel=1e-6, abs=1e-9), i
        assert by[i].kept == (own[i] is not None and score >= 0.5)
    held_out = [i for i, _ in lab if held(i, 5, 0)]
    assert np.mean([by[i].kept == dict(lab)[i] for i in held_out]) > 0.95


# Span dedup


def span_brute(rows):
    cut = span_dedup.Cutter()
    seen, late = {}, collections.defaultdict(set)
    order = sorted(((i if i is not None else math.inf), t) for i, t in rows if t)
    for i, t in order:
        starts, bounds, _ = cut(t.encode())
        words = t.encode().lower().split()
        for k in range(len(starts) - span_dedup.RUN + 1):
            run = tuple(words[bounds[k] : bounds[k + span_dedup.RUN]])
            if len(run) < span_dedup.WORDS:
                continue
            if run in seen:
                late[i].update(range(k, k + span_dedup.RUN))
            else:
                seen[run] = (i, k)
    return late


def test_span_dedup(docs, empty):
    late = span_brute(all_rows())
    got = {r["doc_id"]: r for r in span_dedup.dedup_spans(docs).collect()}
    cut = span_dedup.Cutter()
    for i, t in all_rows():
        gone = late.get(i if i is not None else math.inf, set())
        assert got[i]["n_removed"] == len(gone), i
        if t is None:
            assert got[i]["text"] is None
            continue
        b = t.encode()
        starts, _, _ = cut(b)
        ends = [*starts[1:], len(b)]
        want = b[: starts[0]] + b"".join(b[a:z] for k, (a, z) in enumerate(zip(starts, ends, strict=True)) if k not in gone) if len(starts) else b
        assert got[i]["text"].encode() == want
    assert got[11]["n_removed"] >= got[11]["n_sentences"] - span_dedup.RUN > 0  # an exact copy; its last runs may be too short
    assert got[10]["n_removed"] == 0  # the first of its kind
    assert span_dedup.dedup_spans(empty).count() == 0
    out = span_dedup.replace_texts(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_sentence_cuts():
    starts, bounds, _ = span_dedup.Cutter()("  A b. C d!\nE f  g? ".encode())
    assert starts[0] == 2 and bounds[0] == 0 and bounds[-1] == 7
    assert {2, 4} <= set(bounds.tolist())


def test_planted_passage_goes_but_the_first(docs):
    got = {r["doc_id"]: r["text"] for r in span_dedup.dedup_spans(docs).collect()}
    passage = BASE[:500].split()
    inner = " ".join(passage[25:60])
    hosts = [i for i, t in enumerate(TEXTS) if t and inner in " ".join(t.split())]
    assert len(hosts) > 4
    assert [i for i in hosts if inner in " ".join(got[i].split())] == [10]


def test_repeated_short_lines_go(spark):
    r = np.random.default_rng(21)
    lines = "\n".join("".join(r.choice(list("klmnop"), 6)) for _ in range(60))
    rows = [(k, f"{prose(50, 800 + k)}\n{lines}\n{prose(50, 810 + k)}") for k in range(3)] + [(3, lines), (4, prose(30, 820) + "\n" + "\n".join(lines.split("\n")[:9]))]
    got = {x["doc_id"]: x["text"] for x in span_dedup.replace_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    for k in (1, 2, 3, 4):
        assert not set(lines.split("\n")) & set(got[k].split()), k


def test_span_dedup_with_lengthened_runs(docs):
    cut, seen = span_dedup.Cutter(), {}
    got = {r["doc_id"]: r for r in span_dedup.dedup_spans(docs, lengthen=True).collect()}
    for d, t in all_rows():
        _, b, _ = cut((t or "").encode())
        words, n, gone = (t or "").encode().lower().split(), len(b) - 1, set()
        long_enough = [(i, j) for i in range(n) for j in range(i + span_dedup.RUN, min(n, i + span_dedup.WORDS) + 1) if b[j] - b[i] >= span_dedup.WORDS]
        for i, j in sorted({(i, min(j for k, j in long_enough if k == i)) for i in {p[0] for p in long_enough}} | {(max(i for i, k in long_enough if k == j), j) for j in {p[1] for p in long_enough}}) if n < 200 else ():
            if seen.setdefault(tuple(words[b[i] : b[j]]), (d, i)) != (d, i):
                gone |= set(range(i, j))
        if n < 200:
            assert got[d]["n_removed"] == len(gone), d
    assert got[11]["n_removed"] == got[11]["n_sentences"]


def test_short_copies_and_rows_without_id(spark, monkeypatch):
    """Texts too short for a run, many rows without an id, one id with many texts, and passages in many places."""
    monkeypatch.setattr(span_dedup, "LEAST_HOT", 5)
    monkeypatch.setattr(span_dedup, "PARTS", 4)
    r = np.random.default_rng(31)
    body = [prose(60, 700 + k) for k in range(40)]
    line = " ".join("".join(r.choice(list("klmnop"), 6)) for _ in range(30))
    rows = [(k, "Yes, indeed.") for k in range(3)] + [(3, "yes,  INDEED. "), (4, "One."), (5, ""), (6, None)]
    rows += [(None, f"{b} {k}") for k, b in enumerate(body)] + [(None, body[0] + " 0"), (10, body[1] + " 1")]
    rows += [(11, f"{prose(20, 900 + k)}\n{line}\n{prose(20, 950 + k)}") for k in range(60)]
    got = collections.defaultdict(list)
    for x in span_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), lengthen=True, short=True).collect():
        got[x["doc_id"]].append(x)
    assert [got[k][0]["text"].strip() for k in (0, 1, 2, 3, 4, 5)] == ["Yes, indeed.", "", "", "", "One.", ""] and got[6][0]["text"] is None
    assert got[10][0]["n_removed"] == 0
    late = sorted((x["n_removed"] > 0 for x in got[None]))
    assert len(got[None]) == 41 and late == [False] * 40 + [True]  # only the text that an id has too
    # one id: the first place in order keeps the passage, all others lose it
    whole = [x for x in got[11] if line in " ".join(x["text"].split())]
    assert len(got[11]) == 60 and len(whole) == 1
    words = set(line.split())
    assert sorted(len(words & set(x["text"].split())) for x in got[11])[-2] <= 2 * (2 * span_dedup.LONGEST - 1)


def test_runs_are_the_shortest_from_and_up_to_every_sentence():
    r = np.random.default_rng(22)
    for n in range(1, 40):
        b = np.concatenate(([0], np.cumsum(r.choice([1, 1, 2, 9], n)))).tolist()
        ok = [(i, j) for i in range(n) for j in range(i + span_dedup.RUN, n + 1) if b[j] - b[i] >= span_dedup.WORDS]
        want = {min(p for p in ok if p[0] == i) for i, _ in ok} | {max(p for p in ok if p[1] == j) for _, j in ok}
        i, j = span_dedup.sentences_of(span_dedup.runs_of(np.array(b)))
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(want)


@pytest.mark.parametrize("stops", ["", "."])
def test_repeated_passages_of_51_to_60_words_go(spark, stops):
    r = np.random.default_rng(23)

    def words(n):
        return ["".join(r.choice(list("abcdefghijkl"), 7)) + (stops if r.random() < 0.06 else "") for _ in range(n)]

    passages = [words(n) for n in range(51, 61) for _ in range(8)]
    rows = [(copy * 1000 + k, " ".join([*words(40), *p, *words(40)])) for copy in (0, 1) for k, p in enumerate(passages)]
    got = {x["doc_id"]: x["text"] for x in span_dedup.replace_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, p in enumerate(passages):
        assert got[k] == rows[k][1]
        left = set(got[1000 + k].split())
        there = [w in left for w in p]
        gone = there.index(False), there[::-1].index(False)
        assert max(gone) < 2 * span_dedup.LONGEST and not any(there[gone[0] : len(p) - gone[1]]), (k, gone)
        assert len(left) >= 80


def test_no_sentence_is_longer_than_the_bound():
    r = np.random.default_rng(24)
    for n in (1, 7, 8, 9, 500):
        for text in (" ".join("".join(r.choice(list("abcdefghijkl"), 7)) for _ in range(n)), "word " * n):
            _, bounds, _ = span_dedup.Cutter()(text.encode())
            assert bounds[-1] == n and 1 <= np.diff(bounds).min() <= np.diff(bounds).max() <= span_dedup.LONGEST


# Packing


def test_packing_round_trip(docs, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    got = packing.pack(docs).toPandas()
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in all_rows()}
    pieces = collections.defaultdict(list)
    for r in got.itertuples():
        i = None if pd.isna(r.doc_id) else int(r.doc_id)
        part = ids[i][r.start : r.start + r.length]
        assert len(part) == r.length <= 2048
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        pieces[i].append((r.piece, r.start, r.length))
    for i, x in ids.items():
        p = sorted(pieces[i])
        assert sum(n for *_, n in p) == len(x)
        assert [a for _, a, _ in p] == np.cumsum([0, *[n for *_, n in p[:-1]]]).tolist()
        assert len(p) == -(-len(x) // 2048) and all(n == 2048 for *_, n in p[1:])
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == np.cumsum([0, *g["length"][:-1]]).tolist()
        assert g["length"].sum() <= 2048
    assert packing.pack(empty).count() == 0


def test_equal_rows_are_packed_each(spark, monkeypatch):
    pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(packing, "RANK", 7)
    rows = [(None, "")] * 50 + [(1, "one and the same")] * 40 + [(2, prose(3000, 8))] * 3
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).toPandas()
    assert len(got) == 90 + 3 * got[got.doc_id == 2].piece.nunique()
    assert not got.duplicated(["sequence_id", "offset"]).any()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == np.cumsum([0, *g["length"][:-1]]).tolist()
        assert g["length"].sum() <= 2048


def test_plan_is_tight_and_whole():
    r = np.random.default_rng(5)
    for counts in (collections.Counter(r.integers(1, 2049, 5000).tolist()), {2048: 7}, {700: 5}, {1365: 3, 683: 3}, {1: 5000}, {}, collections.Counter(r.integers(650, 1400, 999).tolist())):
        p = packing.plan(dict(counts))
        used = collections.Counter()
        for many, items in p:
            assert many > 0 and sum(n * k for n, k in items) <= 2048
            assert sum(k for n, k in items if n > 2048 // 3) <= 2
            for n, k in items:
                used[n] += many * k
        assert used == collections.Counter(counts)
        need = -(-sum(n * c for n, c in counts.items()) // 2048)
        if len(counts) > 1000:
            assert sum(m for m, _ in p) <= need * 1.08 + 1


# Language model


def test_language_model(docs, empty, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 60)
    monkeypatch.setattr(lm, "OWN", 20)
    monkeypatch.setattr(lm, "SUFFIXES", 10)
    got = {r["doc_id"]: r for r in lm.score(docs).collect()}
    words = {i: [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None] for i, t in all_rows()}
    c = collections.Counter()
    for i, w in words.items():
        if not held(i, 7, 2):
            c.update(w)
    n, v = sum(c.values()), len(c)
    for i, w in words.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(c[x] > 0 for x in w), n, held(i, 7, 2))
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r["score"] < 0
    assert lm.score(empty).count() == 0


def test_language_model_score_against_brute_force(spark, docs, monkeypatch):
    """Every text's score from the two tables of the networks and plain counts; repeated rows count and score each."""
    for k, v in (("FREQUENT", 200), ("WORDS", 60), ("OWN", 12), ("SUFFIXES", 8), ("STEPS", 50)):
        monkeypatch.setattr(lm, k, v)
    made = {}
    for name in ("train", "train_outputs"):
        monkeypatch.setattr(lm, name, lambda *a, name=name, f=getattr(lm, name): made.setdefault(name, f(*a)))
    d = docs.select("doc_id", "text").unionByName(docs.filter("doc_id in (10, 30)").select("doc_id", "text"))
    got = [(r["doc_id"], r["score"], r["n_tokens"]) for r in lm.score(d).collect()]
    rows = [*all_rows(), (10, TEXTS[10]), (30, TEXTS[30])]
    words = [("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")).encode().split() for _, t in rows]
    count = collections.Counter(w for (i, _), ws in zip(rows, words, strict=True) if not held(i, 7, 2) for w in ws)
    order = sorted(count, key=lambda w: (-count[w], w))
    own = order[:12]
    ends = collections.Counter()
    for w in order[12:]:
        ends[w[-2:]] += count[w]
    endings = sorted(ends, key=lambda e: (-ends[e], e))[:8]
    kind = lambda w: own.index(w) + 1 if w in own else 13 + endings.index(w[-2:]) if w[-2:] in endings else 21
    outputs = order[:60]
    room = collections.Counter()
    for w in order[60:]:
        room[kind(w)] += count[w] + 1
    table, inner = made["train"], made["train_outputs"]
    kinds = np.array([kind(w) for w in outputs] + list(range(22)))
    for k in range(22):
        if not 1 <= k <= 12:
            assert np.abs(np.exp(inner[:, kinds == k].astype(float)).sum(1) - 1).max() < 1e-4
    want = []
    for (i, _), ws in zip(rows, words, strict=True):
        a = b = 0
        s = 0.0
        for w in [*ws, None]:
            k = kind(w) if w is not None else 0
            s += float(table[a * 22 + b, k]) / math.log(10)
            if w in outputs:
                s += float(inner[b, outputs.index(w)]) / math.log(10)
            elif w is not None:
                s += float(inner[b, 60 + k]) / math.log(10) + math.log10((count[w] + 1) / (room[k] + 1))
            a, b = b, k
        want.append((i, s, len(ws) + 1))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for x, y in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert x[0] == y[0] and x[2] == y[2] and x[1] == pytest.approx(y[1], rel=1e-5, abs=1e-4)


def test_class_model_is_normalised_and_learns():
    r = np.random.default_rng(2)
    size = 12
    t, n = [], []
    for a in range(size):
        for b in range(size):
            t.append((a * size + b) * size + (b + 1) % size)
            n.append(100.0)
            t.append((a * size + b) * size + int(r.integers(size)))
            n.append(5.0)
    logp = lm.train(size, np.array(t), np.array(n))
    assert np.abs(np.exp(logp.astype(float)).sum(1) - 1).max() < 1e-4
    assert np.mean([logp[a * size + b].argmax() == (b + 1) % size for a in range(size) for b in range(size)]) > 0.9


def test_triples_do_not_cross_texts():
    two, one, now, stops = lm._triples(np.array([5, 6, 7]), np.array([2, 2, 3]))
    assert now.tolist() == [5, 6, 0, 0, 7, 0]
    assert one.tolist() == [0, 5, 6, 0, 0, 7]
    assert two.tolist() == [0, 0, 5, 0, 0, 0]
    assert stops.tolist() == [2, 3, 5]


# Language identification


def test_forward_sums_all_segmentations():
    p = langid.Pieces(["▁", "a", "b", "ab", "▁a", "bab", "c"])
    table = np.random.default_rng(0).random((8, 2))

    def brute(w, k):
        s, f = "▁" + w, [1.0]
        for j in range(1, len(s) + 1):
            f.append(sum(f[i] * (table[p.pieces.index(s[i:j]), k] if s[i:j] in p.pieces else table[7, k] if j - i == 1 else 0) for i in range(j)))
        return math.log(f[-1])

    words = ["a", "ab", "babab", "x", "abcxbab" * 12]
    assert np.abs(langid.forward(words, p, table) - [[brute(w, 0), brute(w, 1)] for w in words]).max() < 1e-9


def test_expected_counts_are_over_all_segmentations():
    p = langid.Pieces(["▁", "a", "b", "ab", "▁a", "bab", "c"])
    table = np.random.default_rng(3).random(8)

    def cuts(s):
        if not s:
            yield []
        for j in range(1, len(s) + 1):
            if s[:j] in p.pieces or j == 1:
                for rest in cuts(s[j:]):
                    yield [p.pieces.index(s[:j]) if s[:j] in p.pieces else 7, *rest]

    words, n, want = ["ab", "babab", "xa", "abcxbab", "ba"], np.array([1.0, 2.0, 5.0, 1.0, 3.0]), np.zeros(8)
    for w, k in zip(words, n, strict=True):
        ways = list(cuts("▁" + w))
        weight = np.array([np.prod(table[x]) for x in ways])
        for x, v in zip(ways, k * weight / weight.sum(), strict=True):
            np.add.at(want, x, v)
    assert langid.expected(words, n, p, np.log(table)) == pytest.approx(want, rel=1e-9)


def test_marks_alone_are_no_letters(spark):
    pytest.importorskip("public_tokenizers")
    rows = [(i, "the house with green water " * 3, "en") for i in range(20)] + [(100, "\u0301\u0302 \u0301", "en"), (101, "\u0301\u0302 a\u0301", "en")] + [(3, "the house", "en")] * 2
    got = [(x["doc_id"], x["lang_pred"], x["score"]) for x in langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()]
    assert (100, "und", 0.0) in got and [x[1] for x in got if x[0] == 101] == ["en"]
    assert len([x for x in got if x[0] == 3]) == 3


def test_language_id(spark, empty):
    pytest.importorskip("public_tokenizers")
    r = np.random.default_rng(8)
    say = {"aa": ["the", "house", "with", "green", "water"], "bb": ["das", "haus", "mit", "grün", "wasser"], "cc": ["la", "maison", "avec", "vert", "eau"]}
    rows = [(i, " ".join(r.choice(say[k], 30)), k) for i, k in enumerate(r.choice(list(say), 300))]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !!! ___", "aa"), (1003, "das haus " * 5000, None), (None, "la maison", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in langid.language_id(d).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:300])
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] == "bb" and got[None]["lang_pred"] == "cc"
    assert all(x["held_out"] == held(i, 3, 1) and 0 <= x["score"] <= 1 for i, x in got.items())
    assert langid.language_id(empty).count() == 0
    assert {x["lang_pred"] for x in langid.language_id(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# Toxicity


def toxic_texts(n=400):
    r = np.random.default_rng(9)
    bad = ["vilest", "grubworm", "snotling"]
    out, y = [], []
    for i in range(n):
        w = prose(int(r.integers(20, 150)), 2000 + i).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(w) // 30):
                w[int(r.integers(len(w)))] = str(r.choice(bad)) + str(r.choice(["", "s", "ish", "."]))
        out.append(" ".join(w))
        y.append(int(toxic))
    return out, y


def test_toxicity_held_out(spark, empty):
    t, y = toxic_texts()
    d = spark.createDataFrame([*enumerate(t), (9000, None), (9001, ""), (None, t[0]), (9002, prose(9000, 78))], "doc_id long, text string")
    lab = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, lab).collect()}
    test = [i for i in range(len(t)) if held(i, 5, 0)]
    right = [got[i]["predicted"] == y[i] for i in test]
    assert np.mean(right) > 0.9
    assert all(r["held_out"] == held(i, 5, 0) and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    learnt = [v for i, v in enumerate(y) if not held(i, 5, 0)]
    assert got[9000]["score"] == got[9001]["score"] == pytest.approx(np.mean(learnt))  # no evidence: the share of label 1
    assert got[None]["score"] == pytest.approx(got[0]["score"], abs=1e-5)
    assert toxicity.toxicity(empty, lab).count() == 0
    assert {r["score"] for r in toxicity.toxicity(d, lab.filter("toxic = 0")).collect()} == {0.0}
    assert {(r["score"], r["predicted"]) for r in toxicity.toxicity(d, lab.filter("toxic = 1")).collect()} == {(1.0, 1)}
    assert {r["score"] for r in toxicity.toxicity(d, lab.limit(0)).collect()} == {0.0}


def test_toxicity_rows_of_one_id_are_scored_and_dropped_by_themselves(spark):
    t, y = toxic_texts()
    rows = [*enumerate(t), (1, t[0]), (0, t[1]), (0, t[0]), (None, t[0]), (None, t[1])]
    d = spark.createDataFrame([(i, x, k, 0.5) for k, (i, x) in enumerate(rows)], "doc_id long, text string, n int, score double")
    lab = spark.createDataFrame([(i + 1000, v) for i, v in enumerate(y)] + [(5000, 1)], "doc_id long, toxic int")
    lab = lab.withColumn("doc_id", F.col("doc_id") - 1000)
    out = toxicity.clean(d, lab)
    assert out.columns == d.columns
    kept = {r["n"] for r in out.collect()}
    n = len(t)
    assert {n + 1, n + 4} <= kept and not {n, n + 2, n + 3} & kept
    texts, labels_, share = toxicity.sample(d, lab, most=20, chars=3000)
    assert len(texts) == len(labels_) and all(sum(len(x) for x, v in zip(texts, labels_, strict=True) if v == k) <= 3000 for k in (0, 1))
    assert 0 < share < 0.5 and set(labels_) == {0.0, 1.0}


def test_gradient_of_the_network():
    p = {k: v.astype(np.float64) for k, v in toxicity.start_weights(1).items() if k not in ("word", "gram")}
    r = np.random.default_rng(0)
    x = r.standard_normal((6, toxicity.DIM))
    ids = np.array([[1, 2, 3, 4, 5, 1, 0, 0], [2, 2, 5, 1, 3, 4, 5, 1]])
    y, w = np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss(q, v):
        z = toxicity.logits(q, v @ q["Wf"] + q["cf"], v @ q["Wb"] + q["cb"], ids)
        return ((np.logaddexp(0, z) - y * z) * w).sum() / w.sum()

    g = toxicity._step(p, x, ids, y, w)
    for name, at in (("Wf", (3, 5)), ("Ub", (2, 9)), ("A", (4, 2)), ("v", (1,)), ("o", (7,)), ("cb", (20,))):
        q = {k: v.copy() for k, v in p.items()}
        e = 1e-2
        q[name][at] += e
        up = loss(q, x)
        q[name][at] -= 2 * e
        assert g[name][at] == pytest.approx((up - loss(q, x)) / (2 * e), rel=0.05, abs=1e-4), name
    v = x.copy()
    v[2, 3] += 1e-2
    up = loss(p, v)
    v[2, 3] -= 2e-2
    assert g["x"][2, 3] == pytest.approx((up - loss(p, v)) / 2e-2, rel=0.05, abs=1e-4)


def test_windows_cover_every_word():
    for n in (1, 31, 32, 33, 48, 49, 1000):
        s = toxicity.windows_of(n)
        assert set(range(n)) <= {k for a in s for k in range(a, a + toxicity.WINDOW)}


# Exact search


def search_brute(rows, modulus=100, k=10):
    ok = [(i, np.floor(1024 * np.array(e, float)).astype(np.int64)) for i, e in rows if i is not None and e and all(v is not None and math.isfinite(v) for v in e)]
    out = []
    for a, (q, x) in enumerate(ok):
        if q % modulus == 0:
            s = sorted((-int(x @ c), i) for b, (i, c) in enumerate(ok) if a != b and len(c) == len(x))[:k]
            out += [(q, r + 1, i, -v) for r, (v, i) in enumerate(s)]
    return sorted(out)


def test_sql_gives_the_same_rows(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    from tidemark.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, sf_dir)
        cur = con.execute(sql)
        assert df.columns == [c[0] for c in cur.description]
        assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())


def test_search(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=8).round(2).tolist()) for i in range(1000)]
    rows += [(2000 + i, rows[5][1]) for i in range(30)]  # ties
    rows += [(5000, None), (5001, []), (5002, [1.0, None] + [0.0] * 6), (5003, [float("nan")] * 8), (5004, [float("inf")] * 8), (5100, [0.0] * 8), (5200, [1e9] * 8), (5300, [1.0, 2.0]), (None, [1.0] * 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    rows += [(100, rows[7][1]), (100, rows[100][1]), (200, [0.5] * 8), (7, rows[7][1])]  # rows of one id
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = search_brute(rows)
    got = lambda: sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.top_k(d).collect())
    assert got() == want
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "SLICE", 20)
    assert got() == want
    monkeypatch.setattr(topk, "CELLS", 40)
    assert got() == want
    assert topk.top_k(d.limit(0)).count() == 0
    assert len(topk.top_k(d.filter("vec_id < 6")).collect()) == 5


def test_search_sends_queries_where_the_bound_allows(spark, monkeypatch):
    """Clustered vectors: the result is exact though most slices are never asked."""
    monkeypatch.setattr(topk, "SLICE", 50)
    monkeypatch.setattr(topk, "PIVOTS", 8)
    r = np.random.default_rng(16)
    centres = r.normal(size=(12, 6)) * 20
    rows = [(i, (centres[i % 12] + r.normal(size=6) * 0.2).tolist()) for i in range(2400)]
    calls = []
    save = topk.Scratch.save

    def watch(self, df, tag):
        out = save(self, df, tag)
        if tag == "sent":
            calls.append(out.count())
        return out

    monkeypatch.setattr(topk.Scratch, "save", watch)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got) == search_brute(rows)
    assert calls[0] < 24 * 2400 / 50 / 2


# Mixing


def test_mixing(spark, docs, empty):
    s = mixing.schedule(docs, repeat_limit=1.5).toPandas()
    natural = mixing.schedule(docs).toPandas()
    rows = docs.toPandas()
    assert set(s.doc_id.dropna()) == set(rows.doc_id.dropna()) and s.doc_id.isna().any()  # none is lost
    tokens = rows.assign(n=[len(WORD.findall(t or "")) for t in rows.text]).groupby("source").n.sum()
    share = s.groupby("source").n_tokens.sum() / s.n_tokens.sum()
    reps = s.groupby("source").n_tokens.sum() / tokens
    assert reps.max() <= 1.75 and reps.min() >= 0.95
    assert share["hot"] <= tokens["hot"] / tokens.sum() + 1e-9
    assert sorted(s.groupby("block").place.apply(lambda p: sorted(p) == list(range(len(p))))) == [True] * s.block.nunique()
    assert not s.duplicated(["row", "copy"]).any()
    assert mixing.schedule(empty).count() == 0
    m = mixing.mix(docs)
    assert m.columns == docs.columns and m.filter("doc_id is null").count() == natural.doc_id.isna().sum() >= 1
    assert m.count() == len(natural) >= len(rows)


def test_budget_keeps_the_repeat_limit(spark):
    """A budget far above the tokens there are, and one that binds: no row is repeated more often than the limit."""
    r = np.random.default_rng(14)
    rows = [(i, prose(int(r.integers(20, 60)), 300 + i), "big" if i % 8 else "small") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total = sum(len(t.split()) for _, t, _ in rows)
    for budget, limit in ((5 * total, 2.0), (1.5 * total, 2.0), (0.5 * total, 2.0), (1.2 * total, 3.0)):
        s = mixing.schedule(d, budget=budget, repeat_limit=limit).toPandas()
        assert s.groupby("row").copy.count().max() <= math.ceil(limit)
        assert s.n_tokens.sum() == pytest.approx(min(budget, limit * total), rel=0.1)
    share = lambda s: s[s.source == "small"].n_tokens.sum() / s.n_tokens.sum()
    few, many = (mixing.schedule(d, budget=b * total).toPandas() for b in (0.5, 1.9))
    assert share(few) > share(many)


def test_mixing_equal_rows_null_ids_and_empty_texts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_DOCS", 10)
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 25)
    monkeypatch.setattr(mixing, "PARTS", 8)
    rows = [(None, "", "hot")] * 60 + [(1, "a b c", "x")] * 30 + [(1, "d e f g", "y"), (2, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    s = mixing.schedule(d).toPandas()
    assert s.row.nunique() == len(rows) and s.block.nunique() > 2
    m = mixing.mix(d.withColumn("copies", F.lit(5)).withColumn("_c0", F.lit("k")).withColumn("row", F.lit(0)))
    assert m.columns == ["doc_id", "text", "source", "copies", "_c0", "row"]
    assert m.filter("source = 'hot'").count() == 60 and m.filter("source is null").count() == 1
    blank = spark.createDataFrame([(i, None, "s") for i in range(100)], "doc_id long, text string, source string")
    s = mixing.schedule(blank).toPandas()
    assert sorted(s.doc_id) == list(range(100)) and s.groupby("block").doc_id.count().max() <= 60


def test_schedule_against_brute_force(spark):
    """Weights, repetitions and every row's copies from the row order that the schedule states."""
    r = np.random.default_rng(15)
    rows = [(i, prose(int(r.integers(5, 90)), 600 + i), str(r.choice(["a", "b", "c"], p=[0.8, 0.15, 0.05]))) for i in range(300)]
    s = mixing.schedule(spark.createDataFrame(rows, "doc_id long, text string, source string"), repeat_limit=2.0).toPandas()
    n = pd.Series({i: len(t.split()) for i, t, _ in rows})
    src = pd.Series({i: x for i, _, x in rows})
    p = n.groupby(src).sum() / n.sum()

    def weights(a):
        return p**a / (p**a).sum()

    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        reps = weights(mid) / p
        lo, hi = (lo, mid) if reps.max() <= 2.0 * reps.min() else (mid, hi)
    w = weights(hi)
    reps = (w / p) / (w / p).min()
    assert s.groupby("source").weight.first().to_dict() == pytest.approx(w.to_dict(), rel=1e-6)
    copies = s.groupby("doc_id").copy.count()
    assert copies.index.size == 300 and copies.max() <= 2
    for x in p.index:  # one slice for each source of fewer than SLICE_DOCS rows
        extra = n[[i for i in copies.index if src[i] == x and copies[i] == 2]].sum()
        assert abs(extra - (reps[x] - 1) * n[src == x].sum()) <= 90


def test_target_entropy_below_the_natural_one(spark):
    src = spark.createDataFrame([("a", 500, 1), ("b", 300, 1), ("c", 200, 1)], "source_key string, tokens long, n_docs long")
    p = np.array([0.5, 0.3, 0.2])
    w = p**3.7 / (p**3.7).sum()
    assert mixing.bisect_exponent(src, 1000, -(w * np.log(w)).sum(), 0) == pytest.approx(3.7, abs=1e-5)
    even = spark.createDataFrame([("a", 500, 1), ("b", 500, 1)], "source_key string, tokens long, n_docs long")
    assert mixing.bisect_exponent(even, 1000, 0.1, 0) == mixing.MOST


def test_exponent_meets_the_target(spark):
    src = spark.createDataFrame([("a", 1000, 1), ("b", 100, 1), ("c", 10, 1)], "source_key string, tokens long, n_docs long")
    p = np.array([1000, 100, 10]) / 1110

    def entropy(a):
        w = p**a / (p**a).sum()
        return -(w * np.log(w)).sum()

    a = mixing.bisect_exponent(src, 1110, entropy(0.37), 0)
    assert a == pytest.approx(0.37, abs=1e-6)
    a = mixing.bisect_exponent(src, 1110, None, 4.0)
    w = p**a / p
    assert w.max() / w.min() == pytest.approx(4.0, rel=1e-5)
    assert mixing.bisect_exponent(src, 1110, None, 1000.0) == 0.0


def test_blocks_hold_the_mix(spark):
    r = np.random.default_rng(1)
    rows = [(i, prose(int(r.integers(20, 60)), i), "big" if i % 10 else "small") for i in range(2000)]
    s = mixing.schedule(spark.createDataFrame(rows, "doc_id long, text string, source string"), repeat_limit=3.0, block_tokens=10_000).toPandas()
    by = s.pivot_table(index="block", columns="source", values="n_tokens", aggfunc="sum", fill_value=0)
    share = by["small"] / by.sum(axis=1)
    assert len(by) > 5 and share.std() < 0.05
    assert by.sum(axis=1).std() / by.sum(axis=1).mean() < 0.1
