"""Secret scans by an incremental ledger of blobs.

Every version of a file is named by the hash of its content (its blob). The ledger holds, per
blob and rule version, the spans found, also where there are none. A run scans only pairs of
blob and rule version that the ledger lacks, each distinct blob once, and joins what is known
back to every path that has the blob. All of it is DataFrame functions: the text between and the
text of the matches give the positions.

Defined results: a null text counts as empty; rows are judged one by one, so repeated rows, and
rows with a null path, repeat their findings; an empty table gives an empty one; columns other
than the path and the text are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stintwise.operators.lookup import join_pinned


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if its `group` has `least` characters or more. A changed
    pattern needs a new version: the ledger goes by kind and version."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base kinds, in the order in which they are listed.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Parts of a private key in PEM form.
BEGIN, BODY, END = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", r"[A-Za-z0-9+/=\s]*", r"-----END [A-Z ]{0,20}PRIVATE KEY-----"
MORE = (
    # An encrypted key's header lines end at a blank line; where there is none, the END line ends all.
    Rule("private_key", rf"{BEGIN}(?:\s*[A-Za-z][A-Za-z0-9-]*:[\s\S]*?(?:\n[\x20\t\r]*\n{BODY}(?:{END})?|{END})|{BODY}(?:{END})?)", version=2),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_password", r"[a-z][a-z0-9+]{1,15}://[^\x00-\x20/@:]{1,}:[^\x00-\x20/@]{1,}@", version=2),
)
RULES = BASE + MORE

SPAN = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("until", T.IntegerType())])
LEDGER = T.StructType(
    [
        T.StructField("blob", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("spans", T.ArrayType(SPAN)),
    ]
)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def spans_of(text: Column, rule: Rule) -> Column:
    """All leftmost, non-overlapping matches that are long enough, in code points. The parts
    between matches and the matches alternate, so their lengths add up to the positions."""
    none = F.array().cast(T.ArrayType(SPAN))
    pieces = F.arrays_zip(
        F.transform(F.split(text, rule.pattern), lambda x: F.length(x)).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda x: F.length(x)).alias("hit"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda x: F.length(x)).alias("size"),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["hit"], F.lit(0))
        span = F.struct(start.alias("at"), end.alias("until"))
        return F.struct(
            end.alias("at"), F.when(x["size"] >= rule.least, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")
        )

    found = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("spans")), step)["spans"]
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def scan_unseen(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The ledger rows that are still missing for the blobs of `versions`."""
    content = F.coalesce(F.col(text), F.lit(""))
    # Copies of a text meet in one row before anything is sent, so thousands of copies cost one row a task.
    blobs = versions.select(content.alias("text")).groupBy(blob_id(F.col("text")).alias("blob")).agg(F.first("text").alias("text"))
    known = ledger.groupBy(F.col("blob").alias("_blob")).agg(F.collect_set("rule").alias("seen"))
    every = F.array(*[F.lit(r.key) for r in rules])
    todo = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    pending = blobs.join(known, F.col("blob") == F.col("_blob"), "left").select("blob", "text", todo.alias("todo")).filter(F.size("todo") > 0)
    results = [
        F.when(F.array_contains("todo", r.key), F.struct(F.lit(r.key).alias("rule"), spans_of(F.col("text"), r).alias("spans"))) for r in rules
    ]
    scanned = pending.select("blob", F.filter(F.array(*results), lambda x: x.isNotNull()).alias("results"))
    return scanned.select("blob", F.inline("results"))


def findings_by_path(versions: DataFrame, ledger: DataFrame, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, found) for every row of `versions`: found is an array of
    (at, kind_order, kind, until), sorted by start and then by kind."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    kind = F.try_element_at(order, F.col("rule"))
    flat = ledger.filter(kind.isNotNull() & (F.size("spans") > 0)).select("blob", kind.alias("k"), F.inline("spans"))
    per_blob = flat.groupBy("blob").agg(
        F.sort_array(F.collect_set(F.struct("at", F.col("k").alias("kind_order"), F.get(kinds, F.col("k")).alias("kind"), "until"))).alias("found")
    )
    none = F.array().cast(per_blob.schema["found"].dataType)
    rows = versions.select(F.col(path).alias("path"), blob_id(F.col(text)).alias("blob"))
    # Any share of the paths may have the same blob, so the join is salted.
    return join_pinned(rows, per_blob, False, ["blob"], "left").select(
        F.col("path").alias(path), "blob", F.coalesce("found", none).alias("found")
    )


def scan(versions: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES):
    """(findings, additions): what is known of every path of `versions`, and the rows to append
    to the ledger."""
    ledger = empty_ledger(versions.sparkSession) if ledger is None else ledger
    additions = scan_unseen(versions, ledger, rules, text)
    return findings_by_path(versions, ledger.unionByName(additions), path, text, rules), additions


def spans_text(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    one = lambda x: F.concat_ws(":", x["kind"], x["at"].cast("string"), x["until"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns of `docs`, with each found span replaced by `mark`; overlapping spans
    become one. A text without findings stays as it is, null included.

    The spans are joined by content, so copies, null ids and repeated rows need no key."""
    additions = scan_unseen(docs, empty_ledger(docs.sparkSession), rules)
    spans = additions.filter(F.size("spans") > 0).select("blob", F.inline("spans")).groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("at", "until"))).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        kept = F.when(
            x["at"] >= acc["at"],
            F.array_append(acc["parts"], F.substring(F.col("_row.text"), acc["at"] + 1, x["at"] - acc["at"])),
        ).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], x["until"]).alias("at"), kept.alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    folded = F.aggregate("_spans.spans", start, step)
    rows = docs.select(F.struct("*").alias("_row"))
    joined = rows.join(spans.select(F.struct("*").alias("_spans")), blob_id(F.col("_row.text")) == F.col("_spans.blob"), "left").select(
        "_row", F.when(F.col("_spans").isNotNull(), folded).alias("_cut")
    )
    tail = F.substring(F.col("_row.text"), F.col("_cut.at") + 1, F.length("_row.text"))
    clean = F.when(F.col("_cut").isNull(), F.col("_row.text")).otherwise(F.array_join(F.array_append(F.col("_cut.parts"), tail), mark))
    return joined.select(*[clean.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])
