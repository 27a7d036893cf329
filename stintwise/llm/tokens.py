"""Token ids of whole texts by a public tokenizer file, the same as one call for the text gives.

Both files used here split a text into pre-tokens before merging, and a pre-token never runs on
over the end of a word into the space behind it. So a text is cut before its spaces, and the ids
of a piece are kept: most pieces of a corpus repeat. What is kept is bounded (`KEEP` pieces, in
two generations, so that the frequent ones stay).
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np

KEEP = 600_000
SPACE_RUN = re.compile(r"\s ")
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"
LOOSE_LINE = re.compile(r"^\s|\s\s|\s$")


#: How byte-level models write bytes: visible ones as they are, the others as characters from 256 on.
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(VISIBLE)))}


class PieceEncoder:
    def __init__(self, path: str, width: str, space_joins: bool):
        """space_joins: a single space belongs to the word behind it, else spaces are dropped."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.code, self.space_joins = {2: "H", 4: "I"}[np.dtype(width).itemsize], space_joins
        self.model = self.tokenizer.model
        self.young: dict[str, bytes] = {}  # by a piece, as it is behind a space
        self.old: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}  # by what is encoded as it stands

    def raw(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def fill(self, into: dict[str, bytes], missing: list[str], before: str = "") -> None:
        for at in range(0, len(missing), 20_000):
            some = missing[at : at + 20_000]
            into.update(zip(some, self.raw([before + p for p in some] if before else some)))

    def fill_words(self, words: list[str]) -> None:
        """Words of letters alone are one pre-token each, so Latin ones go to the model itself,
        written in its byte signs; the steps before it would cost as much again."""
        rest, young, code, tokenize, lead = [], self.young, self.code, self.model.tokenize, chr(BYTE_SIGNS[32])
        for w in words:
            if w.isascii():  # its letters are their own byte signs
                young[w] = array(code, [t.id for t in tokenize(lead + w if self.space_joins else w.lower())]).tobytes()
            elif max(w) < "\u0250" and "\u0130" not in w:
                form = " " + w if self.space_joins else w.lower()
                signs = form.encode().decode("latin-1").translate(BYTE_SIGNS)
                young[w] = array(code, [t.id for t in tokenize(signs)]).tobytes()
            else:
                rest.append(w)
        self.fill(young, rest, " " if self.space_joins else "")

    def parted(self, piece: str) -> list[tuple[bool, str]]:
        """(behind a space, text) of what a piece consists of: lines, and the signs behind a
        line's last letter, begin pre-tokens of their own."""
        if "\n" not in piece:
            core = piece.rstrip(SIGNS)
            if not core or len(core) == len(piece) or not core[-1].lower().isalpha():
                return [(False, piece)]
            return [(False, core), (True, piece[len(core) :])]
        out = []
        bare = False
        for line in piece.split("\n") if not LOOSE_LINE.search(piece) else [piece]:
            core = line.rstrip(SIGNS)
            if not core or len(core) == len(line) or not core[-1].lower().isalpha():
                core = line
            out.append((bare, ("\n" + core) if bare else core))
            if len(core) < len(line):
                out.append((True, line[len(core) :]))
            bare = self.space_joins
        return out

    def learn(self, pieces: set[str]) -> None:
        """Keeps the ids of new pieces. Their words are mostly known."""
        young, old, bare = self.young, self.old, self.bare
        words, made = set(), []
        for p in pieces:
            if (kept := old.get(p)) is not None:
                young[p] = kept
            elif p.isalpha():
                words.add(p)
            else:
                made.append((p, self.parted(p)))
        if len(bare) > KEEP:
            bare.clear()
        rest = set()
        for _, parts in made:
            for is_bare, x in parts:
                if is_bare:
                    if x not in bare:
                        rest.add(x)
                elif x not in young:
                    words.add(x)
        letters = {w for w in words if w.isalpha()}
        self.fill_words(list(letters))
        self.fill(young, list(words - letters), " " if self.space_joins else "")
        self.fill(bare, list(rest))
        for p, parts in made:
            if len(parts) > 1:
                young[p] = b"".join([bare[x] if is_bare else young[x] for is_bare, x in parts])

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed in `width`. Copies are encoded once."""
        different = list(dict.fromkeys(texts))
        if len(different) < len(texts):
            found = dict(zip(different, self.ids(different)))
            return [found[t] for t in texts]
        if len(self.young) > KEEP:
            self.old, self.young = self.young, {}
        self.young[""] = b""
        out: list[bytes] = [b""] * len(texts)
        get = self.young.get
        odd: list[int] = []
        late: list[tuple[int, list[str], list]] = []
        new: set[str] = set()
        heads: list[str] = []
        for i, t in enumerate(texts):
            if self.space_joins:
                if SPACE_RUN.search(t) or t[:1] == " " or t[-1:] == " ":
                    odd.append(i)  # a run of spaces is parted otherwise
                    continue
                head, _, t = t.partition(" ")
                heads.append(head)
            pieces = t.split(" ")
            values = list(map(get, pieces))
            if None in values:
                new.update([p for p, v in zip(pieces, values) if v is None])
                late.append((i, pieces, values))
            else:
                out[i] = b"".join(values)
        self.learn(new)
        known = self.young
        for i, pieces, values in late:
            out[i] = b"".join([known[p] if v is None else v for p, v in zip(pieces, values)])
        if self.space_joins:
            whole = set(odd)
            for i, h in zip([i for i in range(len(texts)) if i not in whole], self.raw(heads)):
                out[i] = h + out[i]
            cut = [re.split(r"(?<=\S)(?= )", texts[i]) for i in odd]
            flat = self.raw([p for pieces in cut for p in pieces])
            at = 0
            for i, pieces in zip(odd, cut):
                out[i] = b"".join(flat[at : at + len(pieces)])
                at += len(pieces)
        return out


@lru_cache(maxsize=4)
def encoder(path: str, width: str, space_joins: bool) -> PieceEncoder:
    return PieceEncoder(path, width, space_joins)


def in_batches(texts: list[str], chars: int = 4_000_000):
    """Slices of a list of texts, each of about so many characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
