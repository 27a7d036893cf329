"""Removal of word windows that also start in an earlier document, by super-k-mers.

A window is SPAN consecutive words. Its minimiser is the word group of SHORT words in it with the
smallest hash, the leftmost of equals; consecutive windows that share one form a super-k-mer,
which is cut where the minimiser changes and so is the same wherever the passage stands. Equal
windows have equal minimisers, so:

1. every document gives its super-k-mers as (minimiser, digest of the words, id, place);
2. only minimisers that occur in two documents or more go on;
3. equal super-k-mers are one from here on, owned by their smallest id, however many copies there are;
4. where a minimiser has different super-k-mers, each travels once as a packed string to the
   minimiser's bucket, where its windows are sorted, and each is given the smallest owner;
5. a minimiser with very many different strings would crowd its bucket: its windows are grouped
   one by one by their hash instead, which combines before the shuffle;
6. the shared super-k-mers of a document that follow each other form runs; each different run is
   answered once, however many documents hold it, and each document takes its runs' answers and
   drops the words so covered. Copies of a whole text have the same runs.

Defined results: null and empty texts have no words; documents below SPAN words lose none; rows
without an id neither lose words nor take them from others; rows that repeat an id are one
document that doesn't compare with itself, and each row loses its own words; an empty table gives
an empty result; other columns are ignored or, in `strip`, kept whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.llm.text import byte_words
from stintwise.operators.lookup import settle

SPAN, SHORT = 50, 12
GROUPS = SPAN - SHORT + 1  # word groups in a window, and windows in a super-k-mer at most
BATCH_WORDS = 300_000
MANY = 5_000  # strings of a minimiser from which its windows are grouped one by one: 5,000 x 39 windows take 40 MB
BUCKET_STRINGS = 4_000
RUN_CUT = 16
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

U = np.uint64
BASE_1, BASE_2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd, so that they have inverses modulo 2^64


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits spread over the whole of each number."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = WordHashes()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


class RangeHash:
    """Hashes of any ranges of a sequence of numbers, from sums of powers modulo 2^64."""

    def __init__(self, h: np.ndarray, base: int):
        n = len(h) + 1
        powers, inverse = np.full(n, base, dtype=U), np.full(n, pow(base, -1, 2**64), dtype=U)
        powers[0] = inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(h * np.multiply.accumulate(powers)[:-1])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def super_kmers(word_lists: list[list[bytes]]) -> tuple[np.ndarray, ...]:
    """(document, first word, windows, minimiser, digest) of all super-k-mers of some documents."""
    sizes = np.array([len(w) for w in word_lists])
    ends = np.cumsum(sizes)
    h = hashed([x for w in word_lists for x in w])
    total = len(h)
    first = ends - sizes
    short = RangeHash(h, BASE_1)
    at = np.arange(total - SHORT + 1)
    groups = short.of(at, at + SHORT)
    bits = U(max(1, int(total).bit_length()))
    low = (U(1) << bits) - U(1)
    key = (groups & ~low) | at.astype(U)  # smallest hash, leftmost of equals
    width = 1
    m = key
    while width * 2 <= GROUPS:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < GROUPS:
        m = np.minimum(m[: len(m) - (GROUPS - width)], m[GROUPS - width :])
    doc = np.repeat(np.arange(len(sizes)), np.maximum(0, sizes - SPAN + 1))
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(0, sizes - SPAN + 1)) - np.maximum(0, sizes - SPAN + 1), np.maximum(0, sizes - SPAN + 1))
    window = first[doc] + inside
    where = (m[window] & low).astype(np.int64)
    start = np.nonzero(np.concatenate([[True], where[1:] != where[:-1]]))[0]
    count = np.diff(np.concatenate([start, [len(window)]]))
    begin = window[start]
    digest = RangeHash(mixed(h), BASE_2).of(begin, begin + count + SPAN - 1)
    return doc[start], inside[start], count, groups[where[start]], digest


def batches_of(texts):
    """(positions, word lists) of the texts long enough to hold a window, in groups of bounded
    size: only one group's words are held at a time."""
    some, lists, size = [], [], 0
    for i, t in enumerate(texts):
        words = byte_words(t)
        if len(words) >= SPAN:
            some.append(i)
            lists.append(words)
            size += len(words)
            if size >= BATCH_WORDS:
                yield some, lists
                some, lists, size = [], [], 0
    if some:
        yield some, lists


def text_key(text: Column) -> Column:
    """Tells rows that repeat an id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def pieces(docs: DataFrame) -> DataFrame:
    """Super-k-mers of all rows with an id. `at`: first word * 64 + number of windows."""

    def run(batches):
        for pdf in batches:
            ids, keys = pdf["doc_id"].to_numpy(), pdf["tk"].to_numpy()
            for some, lists in batches_of(pdf["text"]):
                d, start, count, minimiser, digest = super_kmers(lists)
                row = np.array(some)[d]
                yield pd.DataFrame({"minimiser": minimiser.view(np.int64), "digest": digest.view(np.int64), "doc": ids[row], "tk": keys[row], "at": start * 64 + count})

    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("tk"))
    return rows.mapInPandas(run, "minimiser long, digest long, doc long, tk long, at long")


def window_matrix(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of packed strings as rows of word numbers, with their string and place."""
    number: dict[bytes, int] = {}
    mats, string, place = [], [], []
    for i, s in enumerate(strings):
        ids = np.array([number.setdefault(w, len(number)) for w in s.split(b" ")], dtype=np.int32)
        mat = np.lib.stride_tricks.sliding_window_view(ids, SPAN)
        mats.append(mat)
        string.append(np.full(len(mat), i))
        place.append(np.arange(len(mat)))
    return np.concatenate(mats), np.concatenate(string), np.concatenate(place)


def earlier_windows(bucket: pd.DataFrame) -> pd.DataFrame:
    """Per string of a bucket a bit mask of the windows that a smaller id owns: the windows are
    sorted by all their words, then by owner, so the first of equals is the owner."""
    mat, string, place = window_matrix(bucket["packed"].tolist())
    owner = bucket["owner"].to_numpy()[string]
    rows = np.ascontiguousarray(mat).view(np.dtype((np.void, mat.itemsize * SPAN))).ravel()
    kind = np.unique(rows, return_inverse=True)[1].ravel()
    order = np.lexsort((owner, kind))
    fresh = np.concatenate([[True], np.diff(kind[order]) != 0])
    least = owner[order][np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    hit = least < owner[order]
    mask = np.zeros(len(bucket), dtype=np.int64)
    np.bitwise_or.at(mask, string[order][hit], np.int64(1) << place[order][hit])
    return pd.DataFrame({"minimiser": bucket["minimiser"], "digest": bucket["digest"], "mask": mask})[mask != 0]


def cut_strings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Packed strings of the wanted super-k-mers, from their owners' texts."""
    per_doc = wanted.groupBy(F.col("owner").alias("doc_id"), "tk").agg(F.collect_list(F.struct("minimiser", "digest", "at", "many")).alias("cuts"))

    def run(batches):
        for pdf in batches:
            out = []
            for owner, text, cuts in zip(pdf["doc_id"], pdf["text"], pdf["cuts"]):
                words = byte_words(text)
                for c in cuts:
                    start, count = divmod(c["at"], 64)
                    out.append((c["minimiser"], c["digest"], owner, c["many"], b" ".join(words[start : start + count + SPAN - 1])))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["minimiser", "digest", "owner", "many", "packed"])
                    out = []
            yield pd.DataFrame(out, columns=["minimiser", "digest", "owner", "many", "packed"])

    joined = keyed(docs).join(per_doc, ["doc_id", "tk"]).select("doc_id", "text", "cuts")
    return joined.mapInPandas(run, "minimiser long, digest long, owner long, many boolean, packed binary")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("tk"))


def one_by_one(packed: DataFrame) -> DataFrame:
    """The masks of `earlier_windows` for minimisers with very many strings: windows are grouped
    by two hashes, and only the smallest owner of each is kept."""

    def run(batches):
        for pdf in batches:
            out = []
            for minimiser, digest, owner, s in zip(pdf["minimiser"], pdf["digest"], pdf["owner"], pdf["packed"]):
                h = hashed(s.split(b" "))
                at = np.arange(len(h) - SPAN + 1)
                out.append(pd.DataFrame({"minimiser": minimiser, "digest": digest, "owner": owner, "place": at, "a": RangeHash(h, BASE_1).of(at, at + SPAN).view(np.int64), "b": RangeHash(mixed(h), BASE_2).of(at, at + SPAN).view(np.int64)}))
            if out:
                yield pd.concat(out)

    windows = packed.mapInPandas(run, "minimiser long, digest long, owner long, place long, a long, b long")
    least = windows.groupBy("a", "b").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).filter("least < most").select("a", "b", "least")
    hit = windows.join(least, ["a", "b"]).filter("least < owner")
    return hit.groupBy("minimiser", "digest").agg(F.bit_or(F.expr("shiftleft(1L, cast(place as int))")).alias("mask"))


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, cuts): per row with something to remove, the first word of a super-k-mer and
    a bit mask of its windows that go."""
    found = settle(pieces(docs))
    most = found.count()
    # Written, so that the join below deals both sides anew and can split a frequent minimiser.
    common = settle(found.groupBy("minimiser").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("minimiser"), most // 2)
    shared = settle(found.join(common, "minimiser", "left_semi"))
    most = shared.count()
    owned = shared.groupBy("minimiser", "digest").agg(F.min(F.struct("doc", "tk", "at")).alias("first"), F.max("doc").alias("last"))
    owned = settle(owned.select("minimiser", "digest", F.col("first.doc").alias("owner"), F.col("first.tk").alias("tk"), F.col("first.at").alias("at"), "last"), most)
    most = owned.count()
    different = owned.groupBy("minimiser").agg(F.count("*").alias("n"), F.min("owner").alias("lo"), F.max("owner").alias("hi")).filter("n > 1 and lo < hi")
    wanted = owned.join(settle(different.select("minimiser", (F.col("n") > MANY).alias("many")), most // 2), "minimiser")
    packed = settle(cut_strings(docs, wanted))
    n_strings = packed.filter(~F.col("many")).count()
    bucket = F.pmod(F.xxhash64("minimiser"), F.lit(-(-n_strings // BUCKET_STRINGS) or 1))
    masks = (
        packed.filter(~F.col("many"))
        .select(bucket.alias("bucket"), "minimiser", "digest", "owner", "packed")
        .groupBy("bucket")
        .applyInPandas(lambda pdf: earlier_windows(pdf), "minimiser long, digest long, mask long")
        .unionByName(one_by_one(packed.filter("many")))
    )
    verdict = owned.join(masks, ["minimiser", "digest"], "left").select("minimiser", "digest", "owner", "last", F.coalesce("mask", F.lit(0)).alias("mask")).filter("mask <> 0 or last > owner")
    verdict = settle(verdict, most)  # so that the join below deals both sides anew and can split a frequent string
    return cuts_of(runs(shared), verdict)


def runs(shared: DataFrame) -> DataFrame:
    """(doc, tk, start, run, content): the shared super-k-mers of each row in runs without a gap.
    A passage's first and last super-k-mers may hold words of the text around it: those that begin
    less than GROUPS - 1 windows behind a gap, or end less than that before one, are runs of their own,
    so that what lies between is the same run in every text. A run also ends after a digest divisible
    by RUN_CUT, wherever the passage stands, so texts that differ in places still have most runs in
    common. `content` counts places from the run's start."""
    shared = shared.dropDuplicates(["doc", "tk", "at"])  # a row that stands many times under one id counts once
    order = Window.partitionBy("doc", "tk").orderBy("at")
    begin, end = F.expr("at div 64"), F.expr("at div 64 + at % 64")
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = shared.withColumn("gap", F.coalesce(begin > reached, F.lit(True)).cast("int")).withColumn("passage", F.sum("gap").over(order))
    whole = Window.partitionBy("doc", "tk", "passage")
    edge = (begin - F.min(begin).over(whole) < GROUPS - 1) | (F.max(end).over(whole) - end < GROUPS - 1)
    edges = gaps.withColumn("edge", edge)
    fresh = (F.col("gap") == 1) | F.col("edge") | F.lag(F.col("edge") | (F.col("digest") % RUN_CUT == 0), 1, True).over(order)
    marked = edges.withColumn("fresh", fresh.cast("int")).withColumn("nr", F.sum("fresh").over(order))
    one = marked.groupBy("doc", "tk", "nr").agg(F.sort_array(F.collect_list(F.struct("at", "minimiser", "digest"))).alias("p"))
    start = F.expr("p[0].at div 64")
    placed = one.select("doc", "tk", start.alias("start"), F.transform("p", lambda x: F.struct((x["at"] - start * 64).alias("at"), x["minimiser"].alias("minimiser"), x["digest"].alias("digest"))).alias("content"))
    name = F.concat_ws(",", F.transform("content", lambda x: F.concat_ws(":", x["minimiser"].cast("string"), x["digest"].cast("string"))))
    return settle(placed.withColumn("run", F.md5(name.cast("binary"))))


def cuts_of(placed: DataFrame, verdict: DataFrame) -> DataFrame:
    """The verdicts on the rows' runs. Each different run looks its super-k-mers up once, and a row
    takes the answer whole: one row per place of a run, not per super-k-mer of every copy."""
    kinds = placed.groupBy("run").agg(F.first("content").alias("content")).select("run", F.explode("content").alias("p")).select("run", "p.*")
    hits = kinds.join(verdict, ["minimiser", "digest"]).groupBy("run").agg(F.collect_list(F.struct("at", "owner", "mask")).alias("hits"))
    hits = settle(hits)  # so that the join below deals both sides anew and can split a frequent run
    judged = placed.select("doc", "tk", "start", "run").join(hits, "run").selectExpr(
        "doc",
        "tk",
        "filter(transform(hits, h -> struct(start + h.at div 64 as start,"
        " if(doc > h.owner, shiftleft(1L, cast(h.at % 64 as int)) - 1, h.mask) as mask)), c -> c.mask <> 0) as cuts",
    )
    return judged.filter(F.size("cuts") > 0).groupBy(F.col("doc").alias("doc_id"), "tk").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))


def covered(n_words: int, cuts) -> np.ndarray:
    """Which words the removed windows cover."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    for c in cuts if cuts is not None else ():
        start, mask = c["start"], c["mask"]
        while mask:
            bit = (mask & -mask).bit_length() - 1
            edge[start + bit] += 1
            edge[start + bit + SPAN] -= 1
            mask &= mask - 1
    return np.cumsum(edge[:-1]) > 0


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""

    def run(batches):
        for pdf in batches:
            out = []
            for doc_id, text, cuts in zip(pdf["doc_id"].tolist(), pdf["text"], pdf["cuts"]):
                words = byte_words(text)
                gone = covered(len(words), cuts)
                kept = b" ".join(words) if not gone.any() else b" ".join([w for w, g in zip(words, gone) if not g])
                out.append((doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"]).astype({"doc_id": "Int64"})

    joined = keyed(docs).join(removals(docs), ["doc_id", "tk"], "left").select("doc_id", "text", "cuts")
    return joined.mapInPandas(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without(text: str, cuts) -> str:
    """The text without its covered words and the white space behind each; all else stays."""
    data = text.encode("utf-8", "replace")
    spans = [m.span() for m in WORD.finditer(data)]
    gone = covered(len(spans), cuts)
    starts = [s for s, _ in spans] + [len(data)]
    out = data[: starts[0]] + b"".join([data[starts[i] : starts[i + 1]] for i in range(len(spans)) if not gone[i]])
    return out.decode("utf-8")


def strip(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs`, without the words found. A text that loses all of them
    stays as an empty one."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([without(t, c) for t, c in zip(text, cuts)])

    rows = docs.select(F.struct("*").alias("_row"))
    found = removals(docs).select(F.struct("*").alias("_cut"))
    on = (F.col("_row.doc_id") == F.col("_cut.doc_id")) & (text_key(F.col("_row.text")) == F.col("_cut.tk"))
    joined = rows.join(found, on, "left")
    hit = joined.filter(F.col("_cut").isNotNull()).select("_row", cut(F.col("_row.text"), F.col("_cut.cuts")).alias("_text"))
    rest = joined.filter(F.col("_cut").isNull()).select("_row", F.col("_row.text").alias("_text"))
    both = hit.unionByName(rest)
    return both.select(*[F.col("_text").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])
