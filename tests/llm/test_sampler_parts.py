"""The sampler's vectorised look-ups against plain ones, and how many prefixes it looks for."""

import numpy as np

from stintwise.llm import segmentations as S
from stintwise.llm.queries import tokenizer_file

TEXTS = ["The year 2024, e.g. (see [3]): naïve café -- ok?!", "你好 world 你好", "", "x" * 300, "a b" * 40, "▁odd ▁▁sign\n\nlines", "12,345.67%;;"]


def test_cuts_and_places_equal_plain_ones():
    lat = S.Lattices(tokenizer_file("piece_bpe_32k.model"))
    pairs = {chr(int(p) >> 32) + chr(int(p) & 0xFFFFFFFF) for p in lat.pairs[:-1]}
    words = sorted({w for t in TEXTS for w in S.parts_of(t)})
    parts, n = lat.cut(words)
    want = []
    for w in words:
        at = [0] + [k for k in range(1, len(w)) if w[k - 1 : k + 1] not in pairs and not w.lstrip(S.SPACE_SIGN).isalpha()] + [len(w)]
        want.append([w[i:j] for i, j in zip(at, at[1:])])
    assert parts == [p for x in want for p in x] and n.tolist() == [len(x) for x in want]
    keys = np.concatenate([lat.keys, np.random.default_rng(1).integers(0, 2**64 - 1, 10_000, dtype=np.uint64), np.array([0], dtype=np.uint64)])
    assert (lat.place_of(keys) == np.searchsorted(lat.keys, keys)).all()


def test_a_cleared_lattice_gives_the_same_samples():
    lat = S.Lattices(tokenizer_file("piece_bpe_32k.model"))
    seeds = np.arange(len(TEXTS), dtype=np.uint64)
    values = lambda: [[(p["value"], lat.ids_of(p["edges"]).tolist()) for p in s.samples] for s in S.sample(lat, TEXTS, seeds, 3)]
    first = values()
    lat.clear()
    S.sample(lat, TEXTS[::-1], seeds, 1)
    assert values() == first


def test_the_last_sample_looks_for_one_prefix_only(monkeypatch):
    lat = S.Lattices(tokenizer_file("piece_bpe_32k.model"))
    seen = []
    aside = S.left_aside
    monkeypatch.setattr(S, "left_aside", lambda *a: seen.append(aside(*a)) or seen[-1])
    S.sample(lat, TEXTS, np.arange(len(TEXTS), dtype=np.uint64), 2)
    assert max(map(len, seen[0])) == 2 and max(map(len, seen[1])) == 1
