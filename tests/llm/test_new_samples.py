"""Importance resampling, mixing of sources and the Merkle manifest, against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintwise.llm import importance, merkle, mixing

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture
def rich(spark):
    """Documents with every column of the table, a clashing one, nulls, repeats and a hot source."""

    def make(rows):
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, size long, tree string, _row long, key string"
        )

    return make


TEXTS = [
    (1, "One two,three 4four\tfünf", "en", "b", 3),
    (2, None, "en", "b", None),
    (3, "", None, "a", 0),
    (4, " \n\t .,;", "de", None, 4),
    (5, "same words here " * 9, "de", "b", 27),
    (5, "same words here " * 9, "de", "b", 27),
    (5, "other words there " * 9, "de", "b", 27),
    (None, "no id at all " * 8, None, None, 8),
    (None, "no id at all " * 8, None, None, 8),
    (6, "long " * 20_000, "fr", "c", 9),
    (7, "Ünïcode 你好 \U0001f600 ÀB " * 10, "fr", "c", None),
    (-8, "a b c d e f g h i j k l m n o p q r s t u", "fr", "c", 1),
]


def full(rows):
    return [(*r, 1, "x", 2, "y") for r in rows]


# --- importance ---------------------------------------------------------------------------


def plain_grams(text, spec):
    words = WORD.findall((text or "").translate(UPPER))
    return [" ".join(words[i : i + n]) for n in range(spec.shortest, spec.longest + 1) for i in range(len(words) - n + 1)]


def plain_ranks(rows, target, spec):
    bucket = lambda g: zlib.crc32(g.encode()) % spec.buckets
    found = [[bucket(g) for g in plain_grams(r[1], spec)] for r in rows]
    s, t = Counter(b for f in found for b in f), Counter(bucket(g) for x in target for g in plain_grams(x, spec))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + spec.buckets) / ((s[b] + 1) * (all_t + spec.buckets))))
    out = []
    for r, f in zip(rows, found):
        h = int(hashlib.sha256(f"{spec.seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        n_words = len(WORD.findall((r[1] or "").translate(UPPER)))
        out.append((r[0], n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= spec.least_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2]))
    drawn = able[: spec.percent * len(able) // 100]
    return Counter([(*x, i + 1) for i, x in enumerate(drawn)] + [(*x, None) for x in list((Counter(out) - Counter(drawn)).elements())])


@pytest.mark.parametrize(
    "spec",
    [
        importance.ImportanceSpec(1, 1, percent=60),
        importance.ImportanceSpec(1, 3, buckets=50, percent=35),
        importance.ImportanceSpec(2, 2, buckets=70_000, least_words=1, percent=100),
        importance.ImportanceSpec(1, 1, percent=0),
    ],
)
def test_ranks_equal_plain_ones(spark, rich, spec):
    target = ["same words 4four", None, "ünïcode no id"]
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.ranks(rich(full(TEXTS)), aim, spec).collect()
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got) == plain_ranks(TEXTS, target, spec)


def test_overlapped_matches_are_all_word_runs():
    spec = importance.ImportanceSpec(1, 4)
    for _, text, *_ in TEXTS[:5] + TEXTS[10:]:
        assert Counter(g.decode() for g in importance.grams(text, spec)) == Counter(plain_grams(text, spec))


def test_resample_returns_the_drawn_documents_whole(spark, rich):
    docs = rich(full(TEXTS))
    aim = spark.createDataFrame([("same words",)], "text string")
    spec = importance.ImportanceSpec(1, 2, percent=50)
    got = importance.resample(docs, aim, spec)
    assert got.columns == [*docs.columns, "drawn"]
    ranks = [r["rank"] for r in importance.ranks(docs, aim, spec).collect() if r["rank"]]
    rows = got.collect()
    assert sorted(r.drawn["rank"] for r in rows) == sorted(ranks)
    assert {(r.doc_id, r.text, r.key) for r in rows} <= {(t[0], t[1], "y") for t in TEXTS}


def test_empty_tables(spark, rich):
    none = spark.createDataFrame([], "text string")
    assert importance.ranks(rich([]), none).collect() == []
    assert all(r.weight <= 0 or r.n_features for r in importance.ranks(rich(full(TEXTS)), none).collect())
    assert mixing.amounts(rich([])).collect() == []
    assert mixing.mix(rich([])).collect() == []
    assert merkle.audit(rich([])).collect() == []


# --- mixing -------------------------------------------------------------------------------


def plain_targets(sizes, spec):
    """By resharing the excess until none is above."""
    weights = {s: spec.weights[i % len(spec.weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, out, open_ = sum(sizes.values()) * spec.percent / 100, {}, set(sizes)
    while open_:
        level = left / sum(weights[s] for s in open_)
        full_ = {s for s in open_ if level * weights[s] > spec.ceiling * sizes[s]}
        if not full_:
            return out | {s: level * weights[s] for s in open_}
        for s in full_:
            out[s] = float(spec.ceiling * sizes[s])
            left -= out[s]
        open_ -= full_
    return out


def many(n=400):
    rng = np.random.default_rng(3)
    sources = ["hot"] * 8 + ["a", "b", "c", None, "d"]
    return [(int(i), "w " * int(rng.integers(0, 60)), "en", sources[int(rng.integers(len(sources)))], 1) for i in range(n)]


def test_amounts_meet_the_targets(rich):
    spec = mixing.MixSpec(block_words=100, shard_words=500)
    for rows in (TEXTS, many()):
        sizes = defaultdict(int)
        for r in rows:
            sizes[r[3]] += len((r[1] or "").split())
        wanted = plain_targets(sizes, spec)
        got = mixing.amounts(rich(full(rows)), spec).collect()
        assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len((r[1] or "").split())) for r in rows)
        assert all(0 <= r.taken <= spec.ceiling * r.size for r in got)
        # Sources are told apart by their size and target here.
        taken, aims = defaultdict(int), {}
        for r in got:
            taken[r.source_size, round(r.target, 6)] += r.taken
        for s in sizes:
            aims[sizes[s], round(wanted[s], 6)] = aims.get((sizes[s], round(wanted[s], 6)), 0) + math.floor(wanted[s] + 0.5)
        assert dict(taken) == aims
        again = mixing.amounts(rich(full(rows[::-1])).repartition(7), spec).collect()
        assert Counter(again) == Counter(got)


def test_the_mix_is_what_amounts_says(rich):
    spec = mixing.MixSpec(block_words=100, shard_words=500)
    docs = rich(full(many()))
    taken = {r.doc_id: r.taken for r in mixing.amounts(docs, spec).collect()}
    rows = mixing.mix(docs, spec).collect()
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id] += r.drawn.words
        assert len(r.text.split()) == r.drawn.words and r.key == "y"
    assert {d: n for d, n in taken.items() if n} == dict(got)
    places = defaultdict(list)
    for r in rows:
        places[r.drawn.shard].append(r.drawn.place)
    assert len(places) > 10
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())


def test_the_tree_parts_every_block_once(spark):
    counts = {"a": 5_000, "b": 1, "c": 777, "d": 0, "e": 20_000}
    total, shards = sum(counts.values()), 37
    quotas = spark.createDataFrame(list(counts.items()), "src string, n long")
    got = mixing.shard_counts(quotas, total, shards, mixing.MixSpec()).collect()
    by_source, by_shard = Counter(), Counter()
    for r in got:
        assert r.n >= 0
        by_source[r.src] += r.n
        by_shard[r.shard] += r.n
    assert by_source == Counter(counts)
    assert [by_shard[k] for k in range(shards)] == [(k + 1) * total // shards - k * total // shards for k in range(shards)]


def test_splits_are_hypergeometric(spark):
    """Inversion at evenly spread numbers gives the distribution itself."""
    n = 4_000
    for pop, good, need in [(50, 20, 25), (10, 9, 5), (100_000, 3, 50_000), (1_000_000, 400_000, 500_000)]:
        u = (F.col("id") + 0.5) / n
        h = mixing.hypergeometric(F.lit(pop).cast("long"), F.lit(good).cast("long"), F.lit(need).cast("long"), u)
        got = np.array([r.h for r in spark.range(n).select(h.alias("h")).collect()])
        mean, var = need * good / pop, need * good / pop * (1 - good / pop) * (pop - need) / (pop - 1)
        assert abs(got.mean() - mean) < 0.02 * math.sqrt(var) + 1e-9
        assert abs(got.var() - var) < 0.03 * var
        if pop == 50:
            exact = np.array([math.comb(good, k) * math.comb(pop - good, need - k) / math.comb(pop, need) for k in range(21)])
            assert np.abs(np.bincount(got, minlength=21) / n - exact).max() < 2 / n


# --- manifest -----------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    n_chars = None if n_chars is None else n_chars + more
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def plain_tree(values):
    """(root, [(side, sibling) from each leaf up])."""
    ways, groups = [[] for _ in values], [[i] for i in range(len(values))]
    while len(values) > 1:
        up, joined = [], []
        for i in range(0, len(values), 2):
            pair = values[i : i + 2]
            for k, members in enumerate(groups[i : i + 2]):
                for m in members:
                    ways[m].append(("LR"[k], pair[1 - k]) if len(pair) == 2 else ("A", ""))
            up.append(sha(*pair))
            joined.append([m for g in groups[i : i + 2] for m in g])
        values, groups = up, joined
    return values[0] if values else None, ways


def plain_audit(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    below = {}
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        below[lang] = plain_tree([plain_leaf(r) for r in trees[lang]])
    root, tops = plain_tree([below[lang][0] for lang in langs])
    out = []
    for lang, top in zip(langs, tops):
        for r, way in zip(trees[lang], below[lang][1]):
            steps = way + top
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            value = plain_leaf(r, 1 if hit else 0)
            for side, other in steps:
                value = sha(other, value) if side == "R" else sha(value, other)
            out.append((r[0], plain_leaf(r), below[lang][0], root, sha(*[s for _, s in steps]), value, value == root))
    return Counter(out)


@pytest.mark.parametrize("rows", [TEXTS, TEXTS[:1], TEXTS[:2], TEXTS[2:5], [TEXTS[4]] * 5, many(700), [(i, "t", "xyz"[i % 3 : i % 3 + 1], "s", i) for i in range(1550)]])
def test_audit_equals_a_plain_tree(rich, rows):
    got = merkle.audit(rich(full(rows))).collect()
    assert Counter(map(tuple, got)) == plain_audit(rows)


def test_three_rounds_of_blocks(rich):
    rows = [(i, "t", "de" if i % 200 else None, "s", i) for i in range(66_500)]
    assert Counter(map(tuple, merkle.audit(rich(full(rows))).collect())) == plain_audit(rows)


def test_more_trees_than_a_block(rich):
    rows = [(i, "t", f"l{i % 300}", "s", None) for i in range(700)]
    assert Counter(map(tuple, merkle.audit(rich(full(rows))).collect())) == plain_audit(rows)
