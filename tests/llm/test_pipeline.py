import corpus_pipeline
from stintwise.llm import chosen_path, neighbours, queries, repeated_windows, secrets
from stintwise.llm.text import documents
from .test_dedup import brute_groups, brute_removal
from .test_tokens_and_files import check_packing

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = documents(spark, SF)
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], SF).cache())
        assert seen[-1].columns == columns
    rows = [[(r["doc_id"], r["text"]) for r in d.collect()] for d in seen]
    groups = brute_groups(rows[1], 5, 80)
    assert sorted(i for i, _ in rows[2]) == sorted(i for i, g in groups.items() if i == g)
    assert {(i, len(t.split())) for i, t in rows[3]} == {(i, n - gone) for i, n, gone, _ in brute_removal(rows[2])}
    assert len(rows[4]) == len(rows[3]) and sum("[SECRET]" in t for _, t in rows[4]) > 0
    left, _ = secrets.scan(seen[4], rules=secrets.BASE)
    assert left.filter("size(found) > 0").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, seen[4], SF).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in rows[4]}
    check_packing(packed, 4096)


def test_run_returns_the_packed_pieces(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-dedup", "substring dedup", "secret scan", "best-fit packing"]
    check_packing(corpus_pipeline.run(spark, SF).collect(), 4096)


def test_stages_take_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (6, 0)], "doc_id long, quality int")
    for docs in (edge_docs, no_docs):
        for stage in (lambda d: neighbours.keep_good(d, labels), chosen_path.one_of_each, repeated_windows.strip, secrets.redact):
            docs = stage(docs)
            assert docs.columns == edge_docs.columns
            docs.count()


def test_every_operator_has_a_query():
    names = [n.split("_")[0] for n in queries.queries()]
    assert names == [f"op{n}" for n in range(1, 11)]
