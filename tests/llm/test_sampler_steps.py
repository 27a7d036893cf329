"""The sampler draws numbers only within reach, cuts texts by plain replacement, and spells all samples at once."""

import numpy as np

from stintwise.llm import segmentations as S
from stintwise.llm.queries import tokenizer_file

TEXTS = ["The year 2024, e.g. (see [3]): naïve café", "你好 world \U0001f600", "", "  two  spaces\nand \n\n lines\t", "nul\0nul \0", "▁odd ▁▁sign", "\n"]


def test_places_out_of_reach_are_not_looked_at(monkeypatch):
    lat = S.Lattices(tokenizer_file("piece_bpe_32k.model"))
    text = "the river with house shining thing and other things under water " * 100
    drawn, paths = [], []
    uniform, aside = S.uniform, S.left_aside

    def looked(lat, some, k):
        monkeypatch.setattr(S, "uniform", lambda *a: drawn.append(len(a) == 3 and len(a[0])) or uniform(*a))
        found = aside(lat, some, k)
        monkeypatch.setattr(S, "uniform", uniform)
        paths.extend((p, f) for (_, p), f in zip(some, found))
        return found

    monkeypatch.setattr(S, "left_aside", looked)
    S.sample(lat, [text] * 100, np.arange(100, dtype=np.uint64), 1)
    within = 0
    for p, found in paths:
        before = np.concatenate([[0.0], np.cumsum(lat.logp[p["edges"]])[:-1]])
        within += int((before >= found[0][0] - S.NEAR).sum())
    assert within <= sum(drawn) <= 1.05 * within


def test_words_are_those_of_the_pattern():
    for t in [*TEXTS, " ", "  ", "\n \n", "a\0b  c", "\r\n a\r\nb", "x " * 50]:
        want = S.PARTS.findall(S.SPACE_SIGN + t.replace(" ", S.SPACE_SIGN)) if t else []
        assert S.parts_of(t) == want


def test_all_samples_are_spelled_at_once(monkeypatch):
    monkeypatch.setattr(S, "RUN", 3)
    lat = S.Lattices(tokenizer_file("piece_bpe_32k.model"))
    found = S.sample(lat, TEXTS, np.arange(len(TEXTS), dtype=np.uint64), 3)
    texts = [t for t, s in zip(TEXTS, found) for _ in s.samples]
    ids = [lat.ids_of(p["edges"]) for s in found for p in s.samples]
    for one in ids:
        assert all(len(lat.bytes_of[i]) for i in one.tolist())
    assert S.decode(lat, ids) == [t.replace(S.SPACE_SIGN, " ").encode() for t in texts]
    assert S.decode(lat, []) == []
    edges = np.concatenate([p["edges"] for s in found for p in s.samples])
    assert lat.ids_of(edges).tolist() == [i for one in ids for i in one.tolist()]
