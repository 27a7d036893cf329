"""Quality rules: a table of thresholds over length, symbol, stop-word and line ratios, compiled
into one Spark projection. No Python runs on the rows and nothing is shuffled.

Defined results: a null text counts as empty; an empty text has zero of everything and fails;
rows are judged one by one, so repeated rows repeat their verdict; an empty table gives an empty
one; columns other than `doc_id` and `text` are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.llm.text import words

WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: Common function words of the languages in the corpus.
STOP_WORDS = (
    "the of and to in a is that it for on was with as be at by are this from an or not he she they we you his her "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an er sie wir ich dem war "
    "le la les de des et en un une du que qui est dans pour pas au sur ce il elle nous vous ne par plus "
    "el los las y que en un una por con no para su al lo como más del se o ha si"
).split()


@dataclass(frozen=True)
class Rule:
    """Keeps a document whose `measure` per `per` lies between `low` and `high`."""

    name: str
    measure: str
    per: str | None
    low: float | None = None
    high: float | None = None

    def passes(self) -> Column:
        value = F.col(self.measure).cast("double")
        if self.per:
            value = F.coalesce(F.try_divide(value, F.col(self.per)), F.lit(0.0))
        checks = [value >= F.lit(self.low)] if self.low is not None else []
        checks += [value <= F.lit(self.high)] if self.high is not None else []
        return reduce(Column.__and__, checks, F.lit(True))


THRESHOLDS = (
    Rule("word length", "word_chars", "n_words", low=2.0, high=20.0),
    Rule("symbols a word", "n_symbols", "n_words", high=0.2),
    Rule("stop words, one granted", "n_stop_words_1", "n_words", low=0.02),
    Rule("words with a letter", "n_letter_words", "n_words", low=0.6),
    Rule("shouted words", "n_upper_words", "n_words", high=0.4),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=0.6),
    Rule("different words", "n_distinct_words", "n_words_sqrt", low=1.9),
)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and every measure that a rule can name, one row per row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        "text",
        words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    w, n = F.col("words"), F.size("words")
    after = lambda i: [F.get("words", i + k) for k in range(1, WINDOW)]
    without_symbols = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SYMBOLS, F.col("text"))
    counted = split.select(
        "doc_id",
        "words",
        n.cast("long").alias("n_words"),
        F.sqrt(n.cast("double")).alias("n_words_sqrt"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(without_symbols)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))) + 1).cast("long").alias("n_stop_words_1"),
        F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        F.size(F.filter(w, lambda x: x.rlike(r"\p{Lu}{2}") & ~x.rlike(r"\p{Ll}"))).cast("long").alias("n_upper_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        F.transform(w, lambda x, i: F.xxhash64(x, *after(i))).alias("hashes"),
    )
    # Equal windows have equal hashes, so only a text with equal hashes is looked at again, by its words.
    ordered = counted.withColumn(
        "ordered",
        F.when(
            (F.col("n_words") >= WINDOW) & (F.size(F.array_distinct("hashes")) < F.size("hashes")),
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(1), F.size("words") - F.lit(WINDOW - 1)),
                    lambda i: F.struct(F.array_join(F.slice("words", i, WINDOW), " ").alias("window"), i.alias("at")),
                )
            ),
        ),
    ).drop("words", "hashes")
    same = lambda k, other: F.get("ordered", k)["window"].eqNullSafe(F.get("ordered", other)["window"])
    twice = F.filter(
        F.sequence(F.lit(0), F.size("ordered") - 1), lambda k: same(k, k - 1) | same(k, k + 1)
    )
    covered = F.array_distinct(
        F.flatten(F.transform(twice, lambda k: F.sequence(F.get("ordered", k)["at"], F.get("ordered", k)["at"] + WINDOW - 1)))
    )
    repeated = F.when(F.col("ordered").isNull(), F.lit(0)).otherwise(F.size(covered))
    return ordered.select("*", repeated.cast("long").alias("n_repeat_words")).drop("ordered")


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """One row per row of `docs`: the measures, `base_failed`, the names of the failed rules, `kept`."""
    base_failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    failed = F.filter(
        F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in rules]), lambda name: name.isNotNull()
    )
    judged = measures(docs).withColumn("base_failed", base_failed).withColumn("failed_rules", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
