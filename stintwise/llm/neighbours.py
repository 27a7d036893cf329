"""Quality scores by nearest-neighbour voting among latent-semantic vectors.

A document's terms are its words and the shapes of its words (which signs and cases they hold),
hashed into fixed buckets; a word that repeats the one before counts as one more term, repetition,
instead. Document frequencies
are counted over all documents. A bounded sample of labelled documents (`per_class` of each
label) gives the latent space, by a truncated singular value decomposition, and the labelled
vectors, which are broadcast: their size depends on the parameters alone. Every document's cosine
with every labelled vector is computed, in blocks, and its nearest neighbours vote by similarity.

Defined results: null and empty texts, and texts without a known term, get the share of label 1
among the rows learned from; rows without an id count as held out; rows are scored one by one, so
repeated rows repeat their score; without labels of both kinds the score is that share, 0.5 if
there is none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.llm.folds import held_out, sample_per_class
from stintwise.llm.text import byte_words

WORDS, SHAPES = 4096, 1024
TERMS = WORDS + SHAPES + 1
SHAPE_OF = bytes.maketrans(
    bytes(range(256)), bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c for c in range(256))
)


@dataclass(frozen=True)
class VoteSpec:
    per_class: int = 1500
    dims: int = 64
    neighbours: int = 10
    sharpness: float = 16.0
    repetition: float = 4.0  # weight of the repetition term among the others
    threshold: float = 0.3


class TermCodes(dict):
    """word -> bucket of the word * SHAPES + bucket of its shape"""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        shape = word.translate(SHAPE_OF)
        runs = bytes(c for i, c in enumerate(shape) if not i or shape[i - 1] != c)
        plain = word.lower().strip(b".,;:!?\"'()")
        code = self[word] = (zlib.crc32(plain) % WORDS) * SHAPES + zlib.crc32(runs) % SHAPES
        return code


CODES = TermCodes()


def term_counts(texts) -> np.ndarray:
    out = np.zeros((len(texts), TERMS), dtype=np.float32)
    for i, t in enumerate(texts):
        words = byte_words(t)
        if words:
            code = np.fromiter(map(CODES.__getitem__, words), dtype=np.int64, count=len(words))
            again = np.concatenate([[False], code[1:] == code[:-1]])
            out[i, :WORDS] = np.bincount(code[~again] // SHAPES, minlength=WORDS)
            out[i, WORDS:-1] = np.bincount(code[~again] % SHAPES, minlength=SHAPES)
            out[i, -1] = again.sum()
    return out


def blocks(texts: list, rows: int = 512):
    for at in range(0, len(texts), rows):
        yield texts[at : at + rows]


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents, and documents per term, over all rows; one partial count per task."""

    def run(batches):
        n, df = 0, np.zeros(TERMS, dtype=np.int64)
        for pdf in batches:
            for some in blocks(pdf["text"].tolist()):
                n += len(some)
                df += (term_counts(some) > 0).sum(0)
        at = np.nonzero(df)[0]
        yield pd.DataFrame({"term": np.concatenate([[-1], at]), "n": np.concatenate([[n], df[at]])})

    counts = docs.select("text").mapInPandas(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(TERMS)
    inside = counts[counts["term"] >= 0]
    df[inside["term"]] = inside["n"]
    return int(counts.loc[counts["term"] < 0, "n"].sum()), df


class Voters:
    """The latent space and the labelled vectors in it."""

    def __init__(self, texts: list[str], labels: list[int], n_docs: int, df: np.ndarray, prior: float, spec: VoteSpec):
        self.idf = np.log((1 + n_docs) / (1 + df)).astype(np.float32) + 1
        self.idf[-1] *= spec.repetition
        self.prior, self.spec = prior, spec
        self.labels = np.array(labels, dtype=np.float32)
        x = self.weighted(texts)
        rng = np.random.default_rng(7)
        dims = min(self.spec.dims, *x.shape) if len(texts) else 1
        q = rng.standard_normal((TERMS, dims + 10), dtype=np.float32)
        for _ in range(3):  # power iterations towards the leading right singular vectors
            q = np.linalg.qr(x.T @ (x @ q))[0]
        _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
        self.space = np.ascontiguousarray((q @ vt.T)[:, :dims]).astype(np.float32)
        self.vectors = self.latent(x)

    def weighted(self, texts) -> np.ndarray:
        x = np.log1p(term_counts(texts)) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def latent(self, x: np.ndarray) -> np.ndarray:
        v = x @ self.space
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if len(set(self.labels.tolist())) < 2:
            return out
        for at in range(0, len(texts), 512):
            v = self.latent(self.weighted(texts[at : at + 512]))
            known = np.linalg.norm(v, axis=1) > 0.5
            cosine = v @ self.vectors.T
            k = min(self.spec.neighbours, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6) ** self.spec.sharpness
            vote = (weight * self.labels[near]).sum(1) / weight.sum(1)
            out[at : at + 512] = np.where(known, vote, out[at : at + 512])
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, spec: VoteSpec = VoteSpec()) -> Voters:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(F.col("quality").isin(0, 1))
    chosen = sample_per_class(known, "quality", spec.per_class, [0, 1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull())
    # The sample is bounded by the parameters, so it can be broadcast.
    sample = texts.join(F.broadcast(chosen), "doc_id").select("text", "quality").toPandas().drop_duplicates("text").sort_values("text")
    prior = known.filter(~held_out(F.col("doc_id"))).agg(F.avg("quality")).first()[0]
    n_docs, df = document_frequencies(docs)
    return Voters(sample["text"].tolist(), sample["quality"].tolist(), n_docs, df, 0.5 if prior is None else float(prior), spec)


def score_column(docs: DataFrame, voters: Voters):
    """A column function from text to score, with the voters broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(text.tolist()))

    return score


def scores(docs: DataFrame, labels: DataFrame, spec: VoteSpec = VoteSpec()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    score = score_column(docs, fit(docs, labels, spec))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= spec.threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, spec: VoteSpec = VoteSpec()) -> DataFrame:
    """The rows and columns of `docs` that are predicted to be good."""
    score = score_column(docs, fit(docs, labels, spec))
    rows = docs.select(F.struct("*").alias("_row"), score("text").alias("_score")).filter(F.col("_score") >= spec.threshold)
    return rows.select("_row.*")
