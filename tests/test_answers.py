"""Rows of one cell are walked through the trees once."""

import numpy as np
import pandas as pd

from stintwise.operators import nodes as N


def test_a_cell_is_walked_once():
    table = pd.DataFrame(
        [(t, n, f, c, a, b, v, 1) for t in (0, 1) for n, f, c, a, b, v in (
            (0, 0, 4.5, 1, 2, 0.0), (1, 1, 0.5 + t, 3, 4, 0.0), (2, None, None, None, None, 7.0 + t), (3, None, None, None, None, 1.0), (4, None, None, None, None, 2.0 - t),
        )],
        columns=["tree", "node", "feature", "threshold", "left", "right", "value", "rows"],
    )
    run, walked = N.Run.of(table), []

    def walk(r, x):
        walked.append(len(x))
        return r.value[r.leaves(x)].sum(1, keepdims=True)

    x = np.array([[a, b, c] for a in range(9) for b in range(4) for c in range(5)], dtype=float)
    answers = N.Answers(run, walk)
    got = [answers.of(part) for part in (x[:60], x[60:], x)]
    want = [[(7.0 if a > 4.5 else 2.0 if b > 0.5 else 1.0) + (8.0 if a > 4.5 else 1.0)] for a, b, _ in x]
    assert np.concatenate(got[:2]).tolist() == want and got[2].tolist() == want
    assert sum(walked) == 6  # two sides of 4.5, three of 0.5 and 1.5


def test_cells_beyond_62_bits_are_all_walked():
    table = pd.DataFrame(
        [(0, n, n, 0.5, 2 * n + 1, 2 * n + 2, 0.0, 1) for n in range(64)] + [(0, n, None, None, None, None, float(n), 1) for n in range(64, 129)],
        columns=["tree", "node", "feature", "threshold", "left", "right", "value", "rows"],
    )
    run = N.Run.of(table)
    answers = N.Answers(run, lambda r, x: r.value[r.leaves(x)])
    x = np.eye(64)[[0, 5, 5]]
    assert not answers.numbered and answers.of(x).tolist() == run.value[run.leaves(x)].tolist()
