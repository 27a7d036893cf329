import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintwise.llm import folds, language_crf, neighbours, queries, segmentations

SF = "/root/testdata/sf0.01"


def test_forward_backward_agrees_with_all_labellings():
    rng = np.random.default_rng(3)
    n, k = 9, 3
    e, moves, start = rng.normal(size=(n, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    first = np.zeros(n, dtype=bool)
    first[[0, 4, 5]] = True
    want = np.zeros((n, k))
    pairs = np.zeros((k, k))
    for a, b in ((0, 4), (4, 5), (5, 9)):
        paths = list(itertools.product(range(k), repeat=b - a))
        w = np.array([math.exp(start[p[0]] + sum(e[a + i, y] for i, y in enumerate(p)) + sum(moves[x, y] for x, y in zip(p, p[1:]))) for p in paths])
        w /= w.sum()
        for p, x in zip(paths, w):
            for i, y in enumerate(p):
                want[a + i, y] += x
            for c, d in zip(p, p[1:]):
                pairs[c, d] += x
    gamma, moved = language_crf.marginals(e, first, moves, start, pairs=True)
    assert np.allclose(gamma, want) and np.allclose(moved, pairs)


def test_code_switched_words_get_their_own_language():
    rnd = random.Random(4)
    en, de = ["the", "with", "house", "shining", "thing", "river"], ["der", "mit", "haus", "schön", "straße", "fluss"]
    text = lambda v: " ".join(rnd.choice(v) for _ in range(60))
    spec = language_crf.FieldSpec(rounds=30)
    field = language_crf.Field(["de", "en"]).fit([text(en) for _ in range(20)] + [text(de) for _ in range(20)], [1] * 20 + [0] * 20, spec)
    words = "the river with house der fluss mit straße the thing".split()
    first = np.zeros(len(words), dtype=bool)
    first[0] = True
    gamma = language_crf.marginals(field.emissions(words), first, field.moves, field.start)
    assert gamma.argmax(1).tolist() == [1, 1, 1, 1, 0, 0, 0, 0, 1, 1]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op2_language_crf(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in got)
    assert len(got) > 100 and right / len(got) > 0.97


def test_language_of_edge_rows(docs_of, edge_docs, no_docs):
    field = language_crf.fit(edge_docs.unionByName(docs_of([(20 + i, "the thing is here") for i in range(5)])))
    got = language_crf.predictions(edge_docs.unionByName(docs_of([(8, "123 456 --")])), field).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == 10 and all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (2, 3, 4, 8))
    assert by_id[1]["lang_pred"] == "en" and 0 <= by_id[1]["score"] <= 1 and by_id[None]["held_out"]
    nothing = language_crf.fit(no_docs)
    assert {r["lang_pred"] for r in language_crf.predictions(edge_docs, nothing).collect()} == {"und"}


def test_batches_do_not_change_languages():
    field = language_crf.Field(["de", "en"]).fit(["the thing with"] * 3 + ["der mit haus"] * 3, [1, 1, 1, 0, 0, 0], language_crf.FieldSpec())
    texts = ["the haus thing", None, "", "der der the", "mit " * 5000]
    lang, score = field.documents(texts)
    for i, t in enumerate(texts):
        one, s = field.documents([t])
        assert one[0] == lang[i] and abs(s[0] - score[i]) < 1e-9


def test_votes_held_out_accuracy(spark):
    larger = "/root/testdata/sf0.1"  # the smaller table holds a handful of bad documents
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    got = queries.op5_neighbour_votes(spark, larger).join(labels.select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.93
    good, bad = [r["score"] for r in got if r["quality"]], [r["score"] for r in got if not r["quality"]]
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_votes_by_brute_force(docs_of):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["good", "fine", "words"] if i % 2 else ["###", "spam", "$$"]) for _ in range(20))) for i in range(60)]
    docs = docs_of(rows)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    voters = neighbours.fit(docs, labels, neighbours.VoteSpec(neighbours=5, dims=4, sharpness=4.0))
    texts = [t for _, t in rows]
    v = voters.latent(voters.weighted(texts))
    for i, s in enumerate(voters.score(texts)):
        near = np.argsort(-(v[i] @ voters.vectors.T))[:5]
        w = np.maximum(v[i] @ voters.vectors[near].T, 1e-6) ** 4
        assert abs(s - (w * voters.labels[near]).sum() / w.sum()) < 1e-3


def test_votes_of_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, 1), (None, 0)], "doc_id long, quality int")
    got = neighbours.scores(edge_docs, labels).collect()
    assert len(got) == 9 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    none = neighbours.scores(edge_docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert neighbours.scores(no_docs, labels).count() == 0
    assert neighbours.keep_good(edge_docs, labels).columns == edge_docs.columns


@pytest.fixture(scope="module")
def lattices():
    return segmentations.lattices(queries.tokenizer_file("piece_bpe_32k.model"))


def all_ways(lat, text):
    roots, _ = lat.roots([text])

    def ways(state):
        if state < 0:
            return [((), 0.0)]
        return [((e, *w), lat.logp[e] + p) for e in range(lat.first[state], lat.first[state + 1]) for w, p in ways(lat.target[e])]

    out = [((), 0.0)]
    for r in roots:
        out = [(a + b, p + q) for a, p in out for b, q in ways(r)]
    return dict(out)


def test_samples_follow_the_exact_probabilities(lattices):
    ways = all_ways(lattices, "a to")
    assert abs(sum(map(math.exp, ways.values())) - 1) < 1e-9
    n = 4000
    found = segmentations.sample(lattices, ["a to"] * n, np.arange(n, dtype=np.uint64), 2)
    first = Counter(tuple(s.samples[0]["edges"].tolist()) for s in found)
    second = Counter(tuple(s.samples[1]["edges"].tolist()) for s in found)
    for s in found:
        a, b = s.samples
        assert a["value"] >= b["value"] and a["edges"].tolist() != b["edges"].tolist()
    for w, p in sorted(ways.items(), key=lambda x: -x[1])[:4]:
        p = math.exp(p)
        later = sum(math.exp(q) * p / (1 - math.exp(q)) for v, q in ways.items() if v != w)
        for got, want in ((first[w], p), (second[w], later)):
            assert abs(got / n - want) < 5 * math.sqrt(want * (1 - want) / n) + 1e-3


def test_small_texts_are_exhausted(lattices):
    ways = all_ways(lattices, "it")
    (s,) = segmentations.sample(lattices, ["it"], np.array([5], dtype=np.uint64), 1000)
    assert {tuple(p["edges"].tolist()) for p in s.samples} == set(ways) and s.log_inclusion(-1.0) == 0.0


def test_round_trip_and_seeds(docs_of, edge_docs, no_docs):
    model = queries.tokenizer_file("piece_bpe_32k.model")
    docs = edge_docs.unionByName(docs_of([(30, "  two  spaces\nand \n lines\t" + "x" * 500), (31, "\U0001f600́ <s> ﷽")]))
    rows = segmentations.segmentations(docs, model, k=3, keep_ids=True).collect()
    assert all(r["round_trip"] for r in rows)
    again = segmentations.segmentations(docs.repartition(7), model, k=3, keep_ids=True).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    per_doc = Counter(r["doc_id"] for r in rows)
    assert per_doc[1] == 3 and per_doc[5] == 6 and per_doc[2] == 1 and per_doc[3] == 1
    assert segmentations.segmentations(no_docs, model).count() == 0


def small_field():
    spec = language_crf.FieldSpec(rounds=30)
    en, de = "the river with house shining thing", "der fluss mit haus schön straße"
    return language_crf.Field(["de", "en"]).fit([en] * 6 + [de] * 6, [1] * 6 + [0] * 6, spec)


def test_every_character_of_a_long_word_counts():
    assert language_crf.words_of("ab " + "x" * 95 + "\tc") == ["ab", "x" * 40, "x" * 40, "x" * 15, "c"]
    for text in ("a b", "", " \x1f ", "y" * 41, "一" * 100 + " z　w"):
        assert language_crf.words_of(text) == language_crf.WORD.findall(text)
    field = language_crf.Field(["ja", "zh"]).fit(["かなです" * 30] * 4 + ["汉字的是" * 30] * 4, [0] * 4 + [1] * 4, language_crf.FieldSpec())
    lang, _ = field.documents(["汉字" * 10 + "かなです" * 300 + "汉字" * 10])  # both ends differ from the middle
    assert lang == ["ja"]


def test_spans_of_code_switched_text(docs_of, edge_docs):
    field = small_field()
    text = "12 the river with house -- der fluss mit  straße! the thing 7"
    got = field.spans([None, text, "", "1 2", "the thing", "der haus"])
    assert [[(text[a:b], k) for a, b, k, _ in got[1]]] == [[("the river with house --", "en"), ("der fluss mit  straße!", "de"), ("the thing 7", "en")]]
    assert got[0] == got[2] == got[3] == [] and [[s[2] for s in x] for x in got[4:]] == [["en"], ["de"]]
    assert all(0.5 <= p <= 1 for x in got for *_, p in x)
    rows = language_crf.spans(edge_docs, field).collect()
    assert len(rows) == 9 and all((r["spans"] == []) == (r["doc_id"] in (2, 3, 4)) for r in rows)
    assert all(r["spans"] == [] for r in language_crf.spans(edge_docs, language_crf.Field([])).collect())


def test_samples_in_one_pass_are_those_by_class(spark):
    rows = spark.createDataFrame([(i % 900, ("a", "b", "c")[min(2, i % 7)]) for i in range(3000)], "doc_id long, lang string")
    one, by_class = folds.first_of_each(rows, "lang", 40), folds.sample_per_class(rows, "lang", 40, ["a", "b", "c"])
    assert sorted(one.collect()) == sorted(by_class.collect()) and one.count() == 120
    assert folds.first_of_each(rows.limit(0), "lang", 40).count() == 0
