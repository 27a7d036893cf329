"""Distinct sampled segmentations of a text into sentence pieces, and their decoding.

A text's segmentations are the paths of a lattice; a path's weight is the product of its pieces'
weights, which fall with the piece's rank in the vocabulary file as natural word counts do. The k
segmentations with the largest Gumbel-perturbed log-probabilities are a sample without
replacement. They are found best first: a prefix carries the largest perturbed value of all paths
behind it, which is one Gumbel number around its own log-probability; of the pieces that may come
next one inherits that value and the others get smaller ones, so the search follows the heir to
the end of the text and then takes up the best prefix left aside. Noise comes from the row's key,
the sample and the place, so a row gets the same result in any batch.

No piece spans a space behind a word, so a text is parted there; the lattice of each different
part is built once. The heirs of all parts of a batch are drawn step by step side by side.

`log_inclusion` is the log-probability that a segmentation is in such a sample, given the largest
value that was left out; 0 where nothing was.

Defined results: a null text counts as empty; an empty text has one segmentation, of no pieces;
fewer than k rows come where a text has fewer segmentations; rows without a key are seeded as key
0; rows that repeat a key and text repeat its rows; an empty table gives an empty result; other
columns are ignored. A text that holds the piece alphabet's own space sign decodes to a space there.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE_SIGN = "▁"
PARTS = re.compile(f"\n|{SPACE_SIGN}+[^{SPACE_SIGN}\n]*|[^{SPACE_SIGN}\n]+")
BYTE_WEIGHT = -12.0  # of each byte of a character without a piece
KEEP = 300_000  # words whose lattices are kept, in some 200 MB
NEAR = 18.0
BATCH_CHARS = 1_000_000
CHUNK = 256  # places of a path that are looked at in one go
DIRECTORY = 20  # leading bits of a hash by which its place among the pieces is looked up
RUN = 1 << 15  # pieces that are spelled in one go
SEVERAL = 2**16 - 1  # in place of an id
U = np.uint64


def uniform(seed: np.ndarray, *counters) -> np.ndarray:
    """Numbers in (0, 1) from counters."""
    x = seed
    for k, c in enumerate(counters):
        x = x ^ (np.atleast_1d(c).astype(U) + U(k + 1)) * U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        x = x ^ (x >> U(31))
    return ((x >> U(11)).astype(np.float64) + 0.5) / 2.0**53


def extended(key: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The hash of a string with one more character."""
    x = (key ^ (code + U(1))) * U(0x9E3779B97F4A7C15)
    return (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)


class Lattices:
    """The lattices of parts, one after another: states (places in a part) and edges (pieces).

    Two characters that follow each other in no piece part a text as a space does, so a word and
    the signs behind it have lattices of their own."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = [b""] * model.get_piece_size()
        self.byte_ids = [0] * 256
        pairs: set[str] = set()
        ids: dict[str, int] = {}
        for i in range(model.get_piece_size()):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(p[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(p[1:-1], 16)])
            elif not model.is_control(i) and not model.is_unknown(i):
                ids[p] = i
                pairs.update(p[k : k + 2] for k in range(len(p) - 1))
                self.bytes_of[i] = p.replace(SPACE_SIGN, " ").encode()
        self.pairs = np.array(sorted(ord(a) << 32 | ord(b) for a, b in pairs) + [2**64 - 1], dtype=U)  # the last is no pair
        for p in list(ids):
            for k in range(1, len(p)):
                ids.setdefault(p[:k], -1)  # only the beginning of a piece
        strings = sorted(ids)
        keys = np.zeros(len(strings), dtype=U)
        for n in range(max(map(len, strings))):
            longer = np.array([len(p) > n for p in strings])
            keys[longer] = extended(keys[longer], np.array([ord(p[n]) for p in strings if len(p) > n], dtype=U))
        order = np.argsort(keys)
        self.keys, self.piece = np.append(keys[order], U(2**64 - 1)), np.append(np.array([ids[p] for p in strings], dtype=np.int64)[order], -1)
        self.directory = np.searchsorted(self.keys[:-1], np.arange(2**DIRECTORY, dtype=U) << U(64 - DIRECTORY))
        rank = np.maximum(1, np.arange(model.get_piece_size()) - 258)
        self.weight = -np.log(rank + 2.7)
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
        self.flat = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)  # the bytes of all pieces, one after another
        self.n_bytes = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.bytes_at = np.cumsum(self.n_bytes) - self.n_bytes
        self.room: dict[str, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}  # of each word; first_part, n_parts and part_roots go by it
        self.root: dict[str, int] = {}
        # `first` has the first edge of each state, `id_at` the first id of each edge, `sole` its only one or `SEVERAL`.
        kinds = {"first": np.int64, "target": np.int32, "logp": float, "upto": float, "id_at": np.int32, "ids": np.uint16, "sole": np.uint16}
        for name, kind in (kinds | dict.fromkeys(("first_part", "n_parts", "part_roots"), np.int64)).items():
            setattr(self, name, np.empty(0, dtype=kind))
        self.append(first=[0], id_at=[0])

    def append(self, **more) -> None:
        """Adds to the arrays; they grow in rooms half as large again, not by a copy each time."""
        for name, x in more.items():
            old = getattr(self, name)
            n = len(old) + len(x)
            if name not in self.room or len(self.room[name]) < n:
                self.room[name] = np.empty(n * 3 // 2, dtype=old.dtype)
                self.room[name][: len(old)] = old
            self.room[name][len(old) : n] = x
            setattr(self, name, self.room[name][:n])

    def cut(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The parts of all words, and how many each has. Words of letters alone stay whole."""
        text = "".join(words)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(U)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        first = np.cumsum(size) - size
        letter = self.letter[code]
        whole = np.logical_or.reduceat(letter, first) & np.logical_and.reduceat(letter | (code == ord(SPACE_SIGN)), first)
        begins = np.repeat(~whole, size)
        begins[first] = True
        inside = np.nonzero(begins[1:])[0]
        pair = code[inside] << U(32) | code[inside + 1]
        begins[inside + 1] = self.pairs[np.searchsorted(self.pairs, pair)] != pair
        begins[first] = True
        at = np.nonzero(begins)[0].tolist()
        return [text[i:j] for i, j in zip(at, [*at[1:], len(text)])], np.add.reduceat(begins, first, dtype=np.int64)

    def place_of(self, key: np.ndarray) -> np.ndarray:
        """The first place among the sorted hashes that is not below each key."""
        place = self.directory[key >> U(64 - DIRECTORY)]
        late = np.nonzero(self.keys[place] < key)[0]
        while len(late):
            place[late] += 1
            late = late[self.keys[place[late]] < key[late]]
        return place

    def build(self, parts: list[str]) -> None:
        """Appends the lattices of new parts, all at once: pieces are found by the hash of what
        has been read from each place, and the weights behind a place are summed from the end."""
        code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(U)
        size = np.array([len(p) for p in parts])
        stop = np.repeat(np.cumsum(size), size)
        base = len(self.first) - 1
        self.root.update(zip(parts, (base + np.cumsum(size) - size).tolist()))
        at, key = np.arange(len(code)), np.zeros(len(code), dtype=U)
        starts, lengths, pieces = [], [], []
        n = 0
        while len(at):
            key = extended(key, code[at + n])
            n += 1
            place = self.place_of(key)
            known = self.keys[place] == key
            at, key, piece = at[known], key[known], self.piece[place[known]]
            whole = piece >= 0
            starts.append(at[whole])
            lengths.append(np.full(whole.sum(), n))
            pieces.append(piece[whole])
            on = at + n < stop[at]
            at, key = at[on], key[on]
        alone = np.ones(len(code), dtype=bool)
        alone[starts[0]] = False
        bare = np.nonzero(alone)[0]  # characters without a piece of their own
        start = np.concatenate([bare, *starts])
        length = np.concatenate([np.ones(len(bare), dtype=np.int64), *lengths])
        piece = np.concatenate([np.full(len(bare), -1), *pieces])
        order = np.argsort(start, kind="stable")  # shorter pieces come first already
        start, length, piece = start[order], length[order], piece[order]
        first = np.searchsorted(start, np.arange(len(code) + 1))
        raw = {int(c): chr(c).encode("utf-8", "replace") for c in np.unique(code[bare])}
        n_ids = np.ones(len(piece), dtype=np.int64)
        spelled = np.nonzero(piece < 0)[0]
        n_ids[spelled] = [len(raw[int(c)]) for c in code[start[spelled]]]
        weight = np.where(piece >= 0, self.weight[piece], BYTE_WEIGHT * n_ids)
        beyond = np.zeros(len(code) + 1)
        last = start + length == stop[start]
        left = stop - np.arange(len(code))  # to the end of the part
        by_left = np.argsort(left, kind="stable")
        bounds = np.searchsorted(left[by_left], np.arange(1, (left.max() if len(left) else 0) + 2))
        for lo, hi in zip(bounds, bounds[1:]):
            states = by_left[lo:hi]
            n_edges = first[states + 1] - first[states]
            edge = np.repeat(first[states] - (np.cumsum(n_edges) - n_edges), n_edges) + np.arange(n_edges.sum())
            weight[edge] += np.where(last[edge], 0.0, beyond[start[edge] + length[edge]])
            beyond[states] = np.logaddexp.reduceat(weight[edge], np.cumsum(n_edges) - n_edges)
        logp = weight - beyond[start]
        # Long floats and rounding: a part's numbers must not depend on what else is in the batch.
        total = np.concatenate([[0.0], np.cumsum(np.exp(logp), dtype=np.longdouble)])
        upto = np.round((total[1:] - total[first[start]]).astype(float), 12)
        upto[first[1:] - 1] = 2.0  # the last edge takes what is left
        ids = np.repeat(piece, n_ids)
        id_at = np.cumsum(n_ids) - n_ids
        for e in spelled:
            ids[id_at[e] : id_at[e] + n_ids[e]] = [self.byte_ids[b] for b in raw[int(code[start[e]])]]
        self.append(first=first[1:] + len(self.target), target=np.where(last, -1, base + start + length), logp=logp, upto=upto)
        self.append(id_at=self.id_at[-1] + np.cumsum(n_ids), ids=ids, sole=np.where(n_ids == 1, ids[id_at], SEVERAL))

    def roots(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """The root states of the parts of all texts, and how many each text has."""
        if len(self.number) > KEEP:
            self.clear()
        words = [parts_of(t) for t in texts]
        flat = list(chain.from_iterable(words))
        number = np.fromiter(map(self.number.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        late = np.nonzero(number < 0)[0]
        if len(late):
            missing = [flat[i] for i in late.tolist()]
            self.add(list(dict.fromkeys(missing)))
            number[late] = np.fromiter(map(self.number.__getitem__, missing), dtype=np.int64, count=len(late))
        n = self.n_parts[number]
        upto = np.concatenate([[0], np.cumsum(n)])
        part = np.repeat(self.first_part[number] - upto[:-1], n) + np.arange(upto[-1])
        return self.part_roots[part], np.diff(upto[np.cumsum([0, *map(len, words)])]).tolist()

    def add(self, words: list[str]) -> None:
        """Cuts new words and builds the lattices of the parts that are new."""
        flat, n = self.cut(words)
        if new := list(set(flat).difference(self.root)):
            self.build(new)
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.append(first_part=len(self.part_roots) + np.cumsum(n) - n, n_parts=n)
        self.append(part_roots=np.fromiter(map(self.root.__getitem__, flat), dtype=np.int64, count=len(flat)))

    def ids_of(self, edges: np.ndarray) -> np.ndarray:
        ids = self.sole[edges]
        more = np.nonzero(ids == SEVERAL)[0]
        if not len(more):
            return ids
        n = np.ones(len(edges), dtype=np.int64)
        n[more] = self.id_at[edges[more] + 1] - self.id_at[edges[more]]
        out = np.repeat(ids, n)
        begin = (np.cumsum(n) - n)[more]
        for i, a, m in zip(begin.tolist(), self.id_at[edges[more]].tolist(), n[more].tolist()):
            out[i : i + m] = self.ids[a : a + m]
        return out

    def walk(self, state: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws each part's way to its end from the given state: the edges in order, and how
        many of each part."""
        count = np.zeros(len(state), dtype=np.int64)
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        act = np.nonzero(state >= 0)[0]
        at = state[act]
        step = 0
        while len(act):
            u = uniform(seed[act], step)
            edge = self.first[at].copy()
            late = np.nonzero(u > self.upto[edge])[0]
            while len(late):
                edge[late] += 1
                late = late[u[late] > self.upto[edge[late]]]
            taken.append((act, edge))
            count[act] += 1
            at = self.target[edge]
            on = at >= 0
            act, at = act[on], at[on]
            step += 1
        start = np.cumsum(count) - count
        edges = np.empty(count.sum(), dtype=np.int64)
        for k, (who, edge) in enumerate(taken):
            edges[start[who] + k] = edge
        return edges, count


def parts_of(text: str) -> list[str]:
    """The parts of a text that no piece crosses."""
    if not text:
        return []
    text = SPACE_SIGN + text.replace(" ", SPACE_SIGN)
    if SPACE_SIGN * 2 in text or "\0" in text:
        return PARTS.findall(text)
    return list(filter(None, text.replace(SPACE_SIGN, "\0" + SPACE_SIGN).replace("\n", "\0\n\0").split("\0")))


def left_aside(lat: Lattices, paths: list[tuple[Search, dict]], k: int) -> list[list[tuple]]:
    """For each path the best prefixes that leave it, as many as may still be taken up or be the
    largest left out: (value, number of pieces kept, edge, log-probability). The path's heir holds
    its value; its sisters' numbers are drawn below it. A search ends where what is left has
    a value within reach only once in 10^8 texts; prefixes that wait from before count as found."""
    found: list[list[tuple]] = [[] for _ in paths]
    need = [k + 1 - len(s.samples) for s, _ in paths]
    waiting = [[-q[0] for q in heapq.nsmallest(n, s.queue)] for n, (s, _) in zip(need, paths)]
    phi = np.array([p["phi0"] for _, p in paths])
    start = np.array([p["fixed"] for _, p in paths])
    reach = np.array([p["value"] for _, p in paths]) - NEAR  # places before which a path falls below are not looked at
    todo = [i for i, (_, p) in enumerate(paths) if start[i] < len(p["edges"])]
    while todo:
        size = np.array([min(CHUNK, len(paths[i][1]["edges"]) - start[i]) for i in todo])
        chosen = np.concatenate([paths[i][1]["edges"][start[i] : start[i] + n] for i, n in zip(todo, size)])
        begin = np.cumsum(size) - size
        run = np.concatenate([[0.0], np.cumsum(lat.logp[chosen], dtype=np.longdouble)])
        before = np.repeat(phi[todo], size) + (run[:-1] - np.repeat(run[begin], size)).astype(float)
        look = before >= np.repeat(reach[todo], size)
        look[begin] = True
        size = np.add.reduceat(look, begin, dtype=np.int64)
        stop = begin + size
        within = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        chosen, before = chosen[within], before[within]
        phi[todo] += (run[stop] - run[begin]).astype(float)
        state = np.concatenate([paths[i][0].states(paths[i][1], start[i], start[i] + n) for i, n in zip(todo, size)])
        at = within + np.repeat(start[todo] - begin, size)
        seed = uniform(np.repeat(np.array([paths[i][0].seed for i in todo], dtype=U), size), np.repeat(np.array([paths[i][1]["number"] for i in todo]), size), at)
        seed = (seed * 2.0**53).astype(U)
        first = lat.first[state]
        n = lat.first[state + 1] - first
        n_before = np.cumsum(n) - n
        which = np.repeat(np.arange(len(chosen)), n)
        order = np.arange(len(which)) - np.repeat(n_before, n)
        own = np.repeat(before, n) + lat.logp[np.repeat(first, n) + order]
        free = own - np.log(-np.log(uniform(np.repeat(seed, n), order)))
        free[n_before + chosen - first] = -np.inf  # the heir's own
        bounds = np.concatenate([[0], np.cumsum(np.add.reduceat(n, np.cumsum(size) - size))])
        more = []
        for x, i in enumerate(todo):
            here = free[bounds[x] : bounds[x + 1]]
            best = np.argpartition(here, -need[i])[-need[i] :] if len(here) > need[i] else np.arange(len(here))
            best = bounds[x] + best[here[best] > -np.inf]
            # a Gumbel number around `own`, given that it is below the path's value
            g = -np.logaddexp(-paths[i][1]["value"], -free[best])
            place = which[best]
            new = zip(g.tolist(), at[place].tolist(), (first[place] + order[best]).tolist(), own[best].tolist())
            found[i] = sorted([*found[i], *new], key=lambda f: -f[0])[: need[i]]
            start[i] += size[x]
            known = sorted([f[0] for f in found[i]] + waiting[i], reverse=True)
            reach[i] = known[need[i] - 1] - NEAR if len(known) >= need[i] else -np.inf
            if start[i] < len(paths[i][1]["edges"]) and phi[i] >= reach[i]:
                more.append(i)
        todo = more
    return found


class Search:
    """The samples of one text, best first."""

    def __init__(self, lat: Lattices, roots: np.ndarray, seed: int, u: float, k: int):
        self.lat, self.roots, self.seed, self.k = lat, roots, seed, k
        self.samples: list[dict] = []
        self.queue: list[tuple] = []
        self.waiting: tuple | None = (-math.log(-math.log(u)), None, 0, -1, 0.0)

    def todo(self) -> np.ndarray | None:
        """The states from which parts have to be walked for the next sample."""
        if self.waiting is None or len(self.samples) >= self.k:
            return None
        _, parent, n, edge, _ = self.waiting
        if parent is None:
            self.kept, self.part = np.empty(0, dtype=np.int64), 0
            return self.roots
        before = self.samples[parent]
        self.part = int(np.searchsorted(before["ends"], n, side="right"))
        self.kept = np.concatenate([before["edges"][:n], [edge]])
        states = self.roots[self.part :].copy()
        states[0] = self.lat.target[edge]
        return states

    def found(self, edges: np.ndarray, logp: np.ndarray, ends: np.ndarray) -> dict:
        """Takes up the way walked: its edges, their log-probabilities, and how many up to each part's end."""
        value, parent, n, edge, phi0 = self.waiting
        if parent is not None:
            edges = np.concatenate([self.kept, edges])
            ends = np.concatenate([self.samples[parent]["ends"][: self.part], n + 1 + ends])
        path = {"value": value, "edges": edges, "ends": ends, "phi0": phi0, "fixed": len(self.kept), "number": len(self.samples) + 1}
        path["phi"] = phi0 + float(logp.sum())
        self.samples.append(path)
        return path

    def states(self, path: dict, start: int, stop: int) -> np.ndarray:
        """The states that a path's edges from `start` up to `stop` leave."""
        states = np.full(stop - start, -1, dtype=np.int64)
        states[int(start == 0) :] = self.lat.target[path["edges"][max(start, 1) - 1 : stop - 1]]
        at = np.nonzero(states < 0)[0]
        states[at] = self.roots[np.searchsorted(path["ends"], at + start, side="right")]
        return states

    def go_on(self, aside: list[tuple]) -> None:
        for g, i, e, own in aside:
            heapq.heappush(self.queue, (-g, len(self.samples) - 1, i, e, own))
        nxt = heapq.heappop(self.queue) if self.queue else None
        self.waiting = None if nxt is None else (-nxt[0], *nxt[1:])

    def log_inclusion(self, phi: float) -> float:
        if self.waiting is None:
            return 0.0
        x = phi - self.waiting[0]
        if x < -30:
            return x
        return math.log(-math.expm1(-math.exp(min(x, 50.0))))


@lru_cache(maxsize=2)
def lattices(path: str) -> Lattices:
    return Lattices(path)


def sample(lat: Lattices, texts: list[str], seeds: np.ndarray, k: int) -> list[Search]:
    """The k samples of each text. Parts of all texts are walked together."""
    roots, sizes = lat.roots(texts)
    at = np.cumsum([0, *sizes])
    searches = [Search(lat, roots[at[i] : at[i + 1]], int(s), u, k) for i, (s, u) in enumerate(zip(seeds, uniform(seeds, 0, 0).tolist()))]
    for turn in range(k):
        todo = [(s, states) for s in searches if (states := s.todo()) is not None]
        if not todo:
            break
        sizes = np.array([len(x) for _, x in todo])
        owner = np.repeat(np.array([s.seed for s, _ in todo], dtype=U), sizes)
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        seed = (uniform(owner, turn + 1000, inside) * 2.0**53).astype(U)
        edges, count = lat.walk(np.concatenate([x for _, x in todo]) if todo else np.empty(0, np.int64), seed)
        logp = lat.logp[edges]
        part_end, edge_end = np.cumsum(sizes), np.cumsum(count)
        paths = []
        for i, (s, states) in enumerate(todo):
            a, b = part_end[i] - sizes[i], part_end[i]
            lo, hi = (edge_end[a - 1] if a else 0), (edge_end[b - 1] if b else 0)
            paths.append((s, s.found(edges[lo:hi], logp[lo:hi], edge_end[a:b] - lo)))
        for (s, _), aside in zip(paths, left_aside(lat, paths, k)):
            s.go_on(aside)
    return searches


def decode(lat: Lattices, samples: list[np.ndarray]) -> list[bytes]:
    """The text of each sample's pieces, without the space that is put before a text."""
    ids = np.concatenate([np.empty(0, dtype=np.uint16), *samples])
    upto = np.concatenate([[0], np.cumsum(lat.n_bytes[ids])])
    out = np.empty(upto[-1], dtype=np.uint8)
    for i in range(0, len(ids), RUN):
        some = ids[i : i + RUN]
        begin = upto[i : i + len(some)]
        at = np.repeat(lat.bytes_at[some] - begin, lat.n_bytes[some])
        at += np.arange(begin[0], begin[0] + len(at))
        np.take(lat.flat, at, out=out[begin[0] : begin[0] + len(at)])
    raw, ends = out.tobytes(), upto[np.cumsum([0, *map(len, samples)])].tolist()
    return [raw[i + (raw[i : min(i + 1, j)] == b" ") : j] for i, j in zip(ends, ends[1:])]


SAMPLES = "doc_id long, rank int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, decoded_crc32 long, round_trip boolean"


def segmentations(docs: DataFrame, model: str, k: int = 2, keep_ids: bool = False) -> DataFrame:
    """k distinct segmentations of every text, best perturbed value first; with `keep_ids` also
    their ids."""

    def run(batches):
        lat = lattices(model)
        for pdf in batches:
            keys, texts = pdf["doc_id"].tolist(), [t or "" for t in pdf["text"]]
            start, size = 0, 0
            for i in range(len(texts) + 1):
                if i == len(texts) or size > BATCH_CHARS:
                    yield rows(lat, keys[start:i], texts[start:i])
                    start, size = i, 0
                if i < len(texts):
                    size += len(texts[i])

    def rows(lat, keys, texts):
        known = [x is not None and x is not pd.NA and x == x for x in keys]
        seeds = np.array([int(x) if ok else 0 for x, ok in zip(keys, known)], dtype=np.int64).view(U)
        out = []
        searches = sample(lat, texts, seeds, k)
        found = [lat.ids_of(p["edges"]) for s in searches for p in s.samples]
        pieces = zip(found, decode(lat, found))
        for key, ok, text, s in zip(keys, known, texts, searches):
            want = text.encode("utf-8", "replace")
            for (rank, p), (ids, back) in zip(enumerate(s.samples), pieces):
                row = (int(key) if ok else None, rank + 1, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), round(p["phi"], 9), round(p["value"], 9), round(s.log_inclusion(p["phi"]), 9), zlib.crc32(back), back == want)
                out.append((*row, ids.tolist()) if keep_ids else row)
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")]).astype({"doc_id": "Int64"})

    schema = SAMPLES + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)
