"""The queries of this subpackage, over the given tables, each beside the SQL that checks it
where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise.llm import chosen_path, exact_topk, importance, language_crf, merkle, mixing, neighbours, packing, quality_rules, record_files, repeated_windows, secrets, segmentations
from stintwise.llm.text import documents


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.group_documents(documents(spark, sf_dir), chosen_path.SetSpec(words=4, percent=80))


def op2_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_crf.predictions(docs, language_crf.fit(docs))


def op3_gumbel_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentations.segmentations(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"), k=2)


def op4_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), end_id=1, capacity=4096)


def op5_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_files.round_trip(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = exact_topk.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return exact_topk.top_k(vectors, F.col("id") % 100 == 0, k=10)


def op9_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows.digests(documents(spark, sf_dir))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan(documents(spark, sf_dir))
    n_base = len(secrets.BASE)
    base = F.filter("found", lambda x: x["kind_order"] < n_base)
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(r.kind) for r in secrets.BASE],
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("found")).alias("spans"),
    )


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    spec = importance.ImportanceSpec(shortest=1, longest=1, buckets=10_000, least_words=20, percent=10, seed=2024)
    return importance.ranks(documents(spark, sf_dir), target, spec).select("doc_id", "n_features", "weight", "score", "rank")


def op12_splitting_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.amounts(documents(spark, sf_dir), mixing.MixSpec(weights=(3, 1, 2), percent=150, ceiling=2))


def op13_time_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(documents(spark, sf_dir))


def queries() -> dict:
    return {
        "op1_chosen_path": op1_chosen_path,
        "op2_language_crf": op2_language_crf,
        "op3_gumbel_topk": op3_gumbel_topk,
        "op4_best_two_fit": op4_best_two_fit,
        "op5_neighbour_votes": op5_neighbour_votes,
        "op6_record_files": op6_record_files,
        "op7_quality_rules": op7_quality_rules,
        "op8_exact_topk": op8_exact_topk,
        "op9_super_kmers": op9_super_kmers,
        "op10_secret_scans": op10_secret_scans,
        "op11_importance": op11_importance,
        "op12_splitting_tree": op12_splitting_tree,
        "op13_time_forward": op13_time_forward,
    }


def oracle_sql() -> dict[str, str]:
    from stintwise.llm import sql

    return sql.by_query()
