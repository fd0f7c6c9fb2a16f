import numpy as np

from shelfwise.llm import mixing


def taken(lengths, counts, budget, cap):
    copies = mixing.fit_budget(np.array(lengths), np.array(counts), budget, 1, cap)
    assert (copies >= 0).all() and (copies <= np.array(counts) * cap).all()
    return int((copies * np.array(lengths)).sum())


def test_long_documents():
    assert taken([150_000, 210_000], [1, 1], 420_000, 3) == 420_000
    assert taken([200_000, 300_000, 500_001], [1, 1, 1], 1_000_002, 2) == 1_000_002
    assert taken([70_000, 90_000], [2, 3], 340_000, 2) == 340_000
