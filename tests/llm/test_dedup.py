import hashlib
import random
import re

import pytest

from stintwise.llm import chosen_path, components, repeated_windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


def brute_removal(rows):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            if i is not None:
                first[g] = min(i, first.get(g, i))
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages(seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    common, long = text(70), text(400)
    rows = []
    for i in range(60):
        w = text(rnd.randint(0, 90))
        if i % 3 == 0:
            at = rnd.randint(0, len(w))
            w = w[:at] + common + w[at:]
        if i % 4 == 0:  # near copies of a long text: many different strings at one minimiser
            copy = list(long)
            for _ in range(4):
                copy[rnd.randrange(400)] = rnd.choice(vocab)
            w += copy
        if i % 5 == 0:
            w += common[:49]
        rows.append((i, " ".join(w)))
    return rows + [(100, rows[0][1]), (101, " ".join(["same"] * 120)), (102, " ".join(["same"] * 60))]


@pytest.mark.parametrize("many", [5_000, 3])
def test_windows_agree_with_brute_force(docs_of, edge_docs, monkeypatch, many):
    monkeypatch.setattr(repeated_windows, "MANY", many)
    rows = passages()
    docs = docs_of(rows).unionByName(edge_docs)
    got = sorted((tuple(r) for r in repeated_windows.digests(docs).collect()), key=str)
    assert got == brute_removal([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_strip_cuts_passages_and_nothing_else(docs_of, edge_docs, no_docs):
    rows = passages(7)
    docs = docs_of(rows).unionByName(edge_docs)
    out = repeated_windows.strip(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    want = {(i, n - g) for i, n, g, _ in brute_removal([(r["doc_id"], r["text"]) for r in docs.collect()])}
    assert {(r["doc_id"], len(words_of(r["text"]))) for r in out.collect()} == want
    assert repeated_windows.without("a  b\n" * 2 + "c ", None) == "a  b\n" * 2 + "c "
    assert repeated_windows.digests(no_docs).count() == 0


@pytest.mark.parametrize("cut", [1, 3, 10**6])
def test_runs_do_not_change_the_result(docs_of, monkeypatch, cut):
    monkeypatch.setattr(repeated_windows, "RUN_CUT", cut)  # 1: each super-k-mer is a run; 10**6: only gaps end one
    texts = dict(passages(3))
    rows = [(i, t) for i, t in texts.items()]
    rows += [(200 + c, texts[0] + " " + texts[4]) for c in range(30)]  # many copies of one text
    rows += [(300, texts[4]), (300, texts[4]), (300, texts[8]), (None, texts[4])]  # an id that repeats, and none
    got = sorted((tuple(r) for r in repeated_windows.digests(docs_of(rows)).collect()), key=str)
    assert got == brute_removal(rows)


def test_copies_share_their_runs(docs_of):
    text = " ".join(f"x{i * i % 977}" for i in range(600))
    docs = docs_of([(i, text) for i in range(40)])
    found = repeated_windows.pieces(docs).distinct()
    placed = repeated_windows.runs(found)
    assert placed.count() == 40 * placed.select("run").distinct().count() < found.count() / 4
    assert placed.selectExpr("sum(size(content))").first()[0] == found.count()


def shingle_set(text, n):
    w = [x for x in re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()]
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_groups(rows, n, percent):
    sets = [(i, shingle_set(t, n)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i, _ in sets}


def near_copies(n_big, seed=2):
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(2000)]
    rows, k = [], 0
    for size in (n_big, 5, 3, 2, 2, 1, 1):
        base = [rnd.choice(vocab) for _ in range(150)]
        for c in range(size):
            w = list(base)
            for _ in range(rnd.randint(0, 7) if c else 0):
                w[rnd.randrange(150)] = rnd.choice(vocab)
            rows.append((k, " ".join(w).upper() if rnd.random() < 0.2 else " ".join(w)))
            k += 1
    return rows


@pytest.mark.parametrize("small", [40, 4])
def test_groups_agree_with_all_pairs(docs_of, monkeypatch, small):
    monkeypatch.setattr(chosen_path, "SMALL", small)  # 4: the group of 60 stays a large node
    docs = docs_of(near_copies(60)).unionByName(docs_of([(i + 1000, t) for i, t in near_copies(4, 3)]))
    docs = docs.unionByName(docs_of([(3000, ""), (3001, None), (None, "no id here at all")]))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    spec = chosen_path.SetSpec(words=4, percent=80)
    got = chosen_path.group_documents(docs, spec).collect()
    want = brute_groups(rows, 4, 80)
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    sizes = {i: len(shingle_set(t, 4)) for i, t in rows}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in got)


def test_edge_rows(edge_docs, no_docs):
    got = chosen_path.group_documents(edge_docs).collect()
    assert len(got) == 9
    by_id = {r["doc_id"]: (r["component_id"], r["kept"], r["n_shingles"]) for r in got}
    assert by_id[5][:2] == (1, False) and by_id[2] == (2, True, 0) and by_id[4] == (4, True, 0) and by_id[None][:2] == (None, True)
    assert by_id[6] == (6, True, 1)
    kept = chosen_path.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == 7
    assert chosen_path.group_documents(no_docs).count() == 0


def test_components_of_a_long_chain(spark):
    rnd = random.Random(1)
    chain = list(range(200))
    rnd.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(900, 901)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(200)} | {900: 900, 901: 900}
