"""Tuples of very long documents are all there."""

from lexiquarry.functions import kernels


def test_tuples_beyond_the_references_buffer():
    n = 70_000
    entries = [(10 * i, 10 * i + 1, 0.5, [(10 * i, 0)]) for i in range(n)]
    assert len(kernels.all_of([entries])) == n
    assert len(kernels.fuzzy([entries], [1.0], [0], 0.7)) == n
