"""Language of words and documents by a linear-chain conditional random field.

States are the languages that the labelled documents name. A word scores by its affixes, its
character groups and its entries in the lexicons of the languages; transitions are learned on
text that switches language: stretches of labelled documents, dealt in turn. The forward-backward
sums over all labellings give each word's probabilities, and a document is in the language that
most of its words with a letter are expected to be in.

The field is fitted on a bounded sample: `per_language` documents, of `per_document` characters
at most, of each language that is not held out, and of the `most_languages` commonest ones. Every
character of every document is labelled: what stands between white space is a word of the chain,
and where that is longer than LONGEST characters, as in scripts without spaces, each LONGEST of
them are. The chain of a batch is worked through in many stretches side by side, whose transfer
matrices are joined afterwards, so a very long document costs no more than as many words
elsewhere, and the result is the same.

`predictions` gives one language a document, `spans` the stretches of each language within it.

Defined results: a null text, or one without a letter, is `und` with score 0 and has no spans;
words without a letter belong to the span that they stand in or behind; rows without an id count
as held out; rows are judged one by one, so repeated rows repeat their result; without any
labelled row all is `und`; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.llm.folds import first_of_each, held_out

UNKNOWN = "und"
LONGEST = 40
BATCH_NUMBERS = 8_000_000  # characters x languages worked through at once
WORD = re.compile(r"\S{1,%d}" % LONGEST)


@dataclass(frozen=True)
class FieldSpec:
    per_language: int = 120
    per_document: int = 50_000
    most_languages: int = 512
    rounds: int = 30
    stretch: int = 24  # words of one document in a row in the training text
    decay: float = 1e-4
    rate: float = 0.3


def words_of(text: str) -> list[str]:
    """The words of a text; the same as WORD finds."""
    words = text.split()
    if len(max(words, key=len, default="")) <= LONGEST:
        return words
    return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]


def word_parts(word: str) -> list[str]:
    """Affixes and character groups of a word."""
    w = word.lower().strip(".,;:!?\"'()[]")
    if not any(c.isalpha() for c in w):
        return ["none"]
    parts = [f"<{w[:k]}" for k in (1, 2, 3) if len(w) > k] + [f"{w[-k:]}>" for k in (1, 2, 3) if len(w) > k]
    marked = f"^{w}$"
    return parts + [marked[i : i + 2] for i in range(len(marked) - 1)] + [marked[i : i + 3] for i in range(len(marked) - 2)]


class Field:
    def __init__(self, languages: list[str]):
        n = len(languages)
        self.languages = languages
        self.parts: dict[str, int] = {}
        self.lexicon: dict[str, tuple[int, ...]] = {}
        self.weights = np.zeros((0, n))
        self.moves, self.start = np.zeros((n, n)), np.zeros(n)
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, n))

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "table": np.zeros((0, len(self.languages)))}

    def features(self, word: str) -> list[int]:
        get = self.parts.get
        found = [i for i in map(get, word_parts(word)) if i is not None]
        return found + [self.parts[f"lexicon {k}"] for k in self.lexicon.get(word.lower().strip(".,;:!?\"'()[]"), ())]

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of the words; those of each different word are computed once."""
        if len(self.known) > 400_000:
            self.known, self.table = {}, np.zeros((0, len(self.languages)))
        fresh = [w for w in set(words).difference(self.known)]
        if fresh:
            lists = [self.features(w) or [0] for w in fresh]
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int64)
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists])[:-1]])
            rows = np.add.reduceat(self.weights[flat], at)
            base = len(self.known)
            self.known.update((w, base + i) for i, w in enumerate(fresh))
            self.table = np.concatenate([self.table[:base], rows])
        return self.table[np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))]

    def fit(self, texts: list[str], labels: list[int], spec: FieldSpec) -> Field:
        counts: dict[str, Counter] = defaultdict(Counter)
        docs = [words_of(t) for t in texts]
        for words, k in zip(docs, labels):
            for w in set(w.lower().strip(".,;:!?\"'()[]") for w in words):
                counts[w][k] += 1
        for w, c in counts.items():
            if sum(c.values()) >= 3:
                self.lexicon[w] = tuple(k for k, n in c.items() if n >= 0.6 * sum(c.values()))
        names = ["none"] + [f"lexicon {k}" for k in range(len(self.languages))]
        seen = Counter(p for w in {w for words in docs for w in words} for p in word_parts(w))
        names += sorted(p for p, n in seen.items() if n >= 2 and p != "none")
        self.parts = {p: i for i, p in enumerate(names)}
        stretches = [(words[i : i + spec.stretch], k) for words, k in zip(docs, labels) for i in range(0, len(words), spec.stretch)]
        order = np.random.default_rng(11).permutation(len(stretches))
        words = [w for s in order for w in stretches[s][0]]
        truth = np.array([stretches[s][1] for s in order for _ in stretches[s][0]])
        if len(words) and len(self.languages) > 1:
            self.learn(words, truth, spec)
        else:
            self.weights = np.zeros((len(self.parts), len(self.languages)))
        return self

    def learn(self, words: list[str], truth: np.ndarray, spec: FieldSpec) -> None:
        """Gradient ascent of the likelihood with steps that adapt to each weight."""
        n_lang, n = len(self.languages), len(words)
        types = {w: i for i, w in enumerate(dict.fromkeys(words))}
        which = np.array([types[w] for w in words])
        lists = [self.features(w) or [0] for w in types]
        flat = np.fromiter((i for x in lists for i in x), dtype=np.int64)
        size = np.array([len(x) for x in lists])
        at, owner = np.concatenate([[0], np.cumsum(size)[:-1]]), np.repeat(np.arange(len(lists)), size)
        self.weights = np.zeros((len(self.parts), n_lang))
        first = np.zeros(n, dtype=bool)
        first[0] = True
        gold = np.zeros((len(types), n_lang))
        np.add.at(gold, (which, truth), 1.0)
        gold_moves = np.zeros((n_lang, n_lang))
        np.add.at(gold_moves, (truth[:-1], truth[1:]), 1.0)
        squares = [np.full(x.shape, 1e-6) for x in (self.weights, self.moves)]
        for _ in range(spec.rounds):
            rows = np.add.reduceat(self.weights[flat], at)
            gamma, moved = marginals(rows[which], first, self.moves, self.start, pairs=True)
            expected = np.stack([np.bincount(which, gamma[:, k], len(types)) for k in range(n_lang)], 1)
            miss = (gold - expected)[owner]
            grad = np.stack([np.bincount(flat, miss[:, k], len(self.parts)) for k in range(n_lang)], 1) / n - spec.decay * self.weights
            for w, g, q in ((self.weights, grad, squares[0]), (self.moves, (gold_moves - moved) / n - spec.decay * self.moves, squares[1])):
                q += g * g
                w += spec.rate * g / np.sqrt(q)

    def batches(self, texts: list) -> Iterator[tuple[int, list]]:
        """The texts in runs of bounded size, each with the number of its first."""
        start, size, most = 0, 0, BATCH_NUMBERS // max(4, len(self.languages))
        for i, t in enumerate(texts):
            if size > most:
                yield start, texts[start:i]
                start, size = i, 0
            size += len(t or "")
        if start < len(texts):
            yield start, texts[start:]

    def labelled(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all words of some documents: the document, the probabilities, whether they have a letter."""
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        words = [w for d in docs for w in d]
        first = np.zeros(len(words), dtype=bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        gamma = marginals(self.emissions(words), first, self.moves, self.start)
        lettered = np.fromiter((any(map(str.isalpha, w)) for w in words), dtype=bool, count=len(words))
        return np.repeat(np.arange(len(docs)), sizes), gamma, lettered

    def documents(self, texts: list) -> tuple[list[str], np.ndarray]:
        """The language of each text and the expected share of its words in it."""
        out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for base, some in self.batches(texts):
            docs = [words_of(t or "") for t in some]
            if not self.languages or not any(docs):
                continue
            doc, gamma, lettered = self.labelled(docs)
            total = np.bincount(doc[lettered], minlength=len(docs))
            share = np.stack([np.bincount(doc[lettered], gamma[lettered, k], len(docs)) for k in range(gamma.shape[1])], 1)
            for i in np.nonzero(total)[0]:
                k = int(share[i].argmax())
                out[base + i], score[base + i] = self.languages[k], min(1.0, max(0.0, share[i, k] / total[i]))
        return out, score

    def spans(self, texts: list) -> list[list[tuple[int, int, str, float]]]:
        """Per text the stretches of words whose likeliest language is the same: first character,
        end, language, mean probability of the words with a letter."""
        out: list[list] = [[] for _ in texts]
        for base, some in self.batches(texts):
            found = [[(m.start(), m.end()) for m in WORD.finditer(t or "")] for t in some]
            if not self.languages or not any(found):
                continue
            doc, gamma, lettered = self.labelled([[t[a:b] for a, b in at] for t, at in zip(some, found)])
            place = np.array([x for at in found for x in at])
            kind = gamma.argmax(1)
            seen = np.nonzero(lettered)[0]
            fresh = np.ones(len(seen), dtype=bool)
            fresh[1:] = (doc[seen[1:]] != doc[seen[:-1]]) | (kind[seen[1:]] != kind[seen[:-1]])
            starts = np.nonzero(fresh)[0]
            for at, to in zip(starts, np.append(starts[1:], len(seen))):
                i = seen[at]
                last = seen[to] - 1 if to < len(seen) and doc[seen[to]] == doc[i] else np.searchsorted(doc, doc[i], "right") - 1
                p = float(gamma[seen[at:to], kind[i]].mean())
                out[base + doc[i]].append((int(place[i, 0]), int(place[last, 1]), self.languages[kind[i]], p))
        return out


def marginals(e: np.ndarray, first: np.ndarray, moves: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Forward-backward probabilities of the words of one long row of chains; `first` marks where
    a chain begins. With `pairs` also the expected number of each move."""
    n, k = e.shape
    steps = max(1, int(np.sqrt(n)))
    rows = -(-n // steps)
    x = np.ones((rows * steps, k))
    x[:n] = np.exp(e - e.max(1, keepdims=True))
    begin = np.ones(rows * steps, dtype=bool)
    begin[:n] = first
    x = np.ascontiguousarray(x.reshape(rows, steps, k).transpose(1, 0, 2))
    begin = np.ascontiguousarray(begin.reshape(rows, steps).T)
    p, s = np.exp(moves), np.exp(start)
    m = np.repeat(np.eye(k)[None], rows, 0)
    for t in range(steps):  # transfer matrix of each stretch
        m = np.where(begin[t][:, None, None], m.sum(2, keepdims=True) * s, (m.reshape(-1, k) @ p).reshape(rows, k, k)) * x[t][:, None, :]
        m /= m.sum((1, 2), keepdims=True)
    enter, leave = np.ones((rows, k)) / k, np.ones((rows, k)) / k
    for r in range(rows - 1):
        v = enter[r] @ m[r]
        enter[r + 1] = v / v.sum()
    for r in range(rows - 1, 0, -1):
        v = m[r] @ leave[r]
        leave[r - 1] = v / v.sum()
    alpha, beta = np.empty_like(x), np.empty_like(x)
    a, b = enter, leave
    for t in range(steps):
        a = np.where(begin[t][:, None], s, a @ p) * x[t]
        a /= a.sum(1, keepdims=True)
        alpha[t] = a
    for t in range(steps - 1, -1, -1):
        beta[t] = b
        y = x[t] * b
        b = np.where(begin[t][:, None], (y * s).sum(1, keepdims=True), y @ p.T)
        b /= b.sum(1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    flat = gamma.transpose(1, 0, 2).reshape(-1, k)[:n]
    if not pairs:
        return flat
    left = alpha.transpose(1, 0, 2).reshape(-1, k)[: n - 1]
    right = (x * beta).transpose(1, 0, 2).reshape(-1, k)[1:n]
    joint = left[:, :, None] * p[None] * right[:, None, :]
    joint /= joint.sum((1, 2), keepdims=True)
    return flat, joint[~first[1:]].sum(0)


def fit(docs: DataFrame, spec: FieldSpec = FieldSpec()) -> Field:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").alias("lang")).filter("text is not null and lang is not null")
    learn = rows.filter(~held_out(F.col("doc_id")))
    languages = sorted(r["lang"] for r in learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(spec.most_languages).collect())
    if not languages:
        return Field([]).fit([], [], spec)
    named = rows.filter(F.col("lang").isin(languages)).select("doc_id", "lang")
    chosen = first_of_each(named, "lang", spec.per_language).select("doc_id").distinct()
    text = F.substring("text", 1, spec.per_document).alias("text")
    sample = learn.join(F.broadcast(chosen), "doc_id").select(text, "lang").toPandas().drop_duplicates("text").sort_values("text")
    at = {lang: i for i, lang in enumerate(languages)}
    sample = sample[sample["lang"].isin(at)]
    return Field(languages).fit(sample["text"].tolist(), [at[x] for x in sample["lang"]], spec)


def predictions(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("lang_pred string, score double")
    def label(text: pd.Series) -> pd.DataFrame:
        lang, score = shared.value.documents(text.tolist())
        return pd.DataFrame({"lang_pred": lang, "score": score})

    judged = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), label("text").alias("p"))
    return judged.select("doc_id", "held_out", "p.lang_pred", "p.score")


def spans(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, spans) of every row: the stretches of each language, with first character and end
    in code points. A text without a letter, and one judged by an empty field, has none."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("array<struct<start:int,end:int,lang:string,probability:double>>")
    def label(text: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("start", "end", "lang", "probability"), s)) for s in x] for x in shared.value.spans(text.tolist())])

    return docs.select("doc_id", label("text").alias("spans"))
