"""Documents that repeat an id with different texts, and plans against plainer packers."""

import random

import numpy as np
import pytest

from stintwise.llm import chosen_path, packing
from tests.llm.test_dedup import brute_groups, near_copies


def test_an_id_with_two_texts_links_both(docs_of):
    a, b, *_ = [" ".join(f"{c}{i}" for i in range(120)) for c in "abc"]
    near = lambda t: t.replace("50 ", "x ")
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (4, "nothing like them at all here"), (1, a)]
    spec = chosen_path.SetSpec(words=4, percent=80)
    got = {(r.doc_id, r.component_id, r.kept) for r in chosen_path.group_documents(docs_of(rows), spec).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)}


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_the_sketch_follows_the_similarity(docs_of, percent):
    assert chosen_path.SetSpec(percent=percent).least_bits(0) == int(64 * (1 + percent / 100))
    rows = near_copies(20, 11) + [(i + 500, t) for i, t in near_copies(3, 12)]
    spec = chosen_path.SetSpec(words=4, percent=percent)
    got = {r.doc_id: r.component_id for r in chosen_path.group_documents(docs_of(rows), spec).collect()}
    assert got == brute_groups(rows, 4, percent)


def best_fit_decreasing(lengths, capacity):
    room = {}  # gap -> bins
    bins = 0
    for n in sorted(lengths, reverse=True):
        gap = min((g for g in room if g >= n and room[g]), default=None)
        if gap is None:
            bins, gap = bins + 1, capacity
        else:
            room[gap] -= 1
        room[gap - n] = room.get(gap - n, 0) + 1
    return bins


@pytest.mark.parametrize("capacity,n", [(10, 300), (100, 2000), (4096, 3000)])
def test_plans_need_no_more_than_best_fit_decreasing(capacity, n):
    rnd = random.Random(capacity)
    for share in (1.0, 0.5, 0.2):
        lengths = [max(1, min(capacity, int(rnd.expovariate(1 / (capacity * share))))) for _ in range(n)]
        counts = np.bincount(lengths, minlength=capacity + 1)
        bins = packing.plan(counts, capacity)
        assert sum(t for _, t in bins) <= best_fit_decreasing(lengths, capacity)
        assert max(sum(x) for x, _ in bins) <= capacity
