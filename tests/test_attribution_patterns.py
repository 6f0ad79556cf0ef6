"""A path's effects are computed once for each pattern of passed features, not for each row."""

import numpy as np
import pytest

from screenlens.operators import attribution as A


def chain(depth):
    """A tree that splits on another feature at each level of its left side."""
    nodes = {f: A.Node((1.0,), 0.0, 2.0 ** (depth - f), f + 1, 100 + f, f, 0.1 * f) for f in range(depth)}
    nodes |= {100 + f: A.Node((1.0,), f + 1.0, 2.0 ** (depth - f - 1)) for f in range(depth)}
    nodes[depth] = A.Node((1.0,), -1.0, 1.0)
    return A._grow(nodes, lambda n: [n.prediction])


@pytest.mark.parametrize("rows", [1, 5000])
def test_patterns_equal_the_rows_done_directly(monkeypatch, rows):
    x = np.random.default_rng(3).normal(size=(rows, 5))
    ensemble = A.AdditiveTrees((chain(5),), 1)
    lines = []
    others = A._others
    monkeypatch.setattr(A, "_others", lambda p, s: lines.append(len(p)) or others(p, s))
    found = ensemble.contributions(x)
    assert max(lines) <= min(rows, 2 ** 5)
    monkeypatch.setattr(A, "PATTERN_FEATURES", 0)
    assert np.array_equal(found, ensemble.contributions(x)) and max(lines) <= max(A.DIRECT_ROWS, 2 ** 5)
