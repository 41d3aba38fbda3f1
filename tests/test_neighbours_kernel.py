"""The k nearest by matrix products are those of plain distances, ties and copies included."""

import numpy as np
import pytest

from quorumstat.operators.neighbours import _near


@pytest.mark.parametrize("skip", [False, True])
@pytest.mark.parametrize("shift", [0.0, 1e4])
def test_equals_plain_distances(skip, shift):
    g = np.random.default_rng(3)
    b = g.normal(size=(600, 16)).astype(np.float32).astype(float) + shift
    b[300:] = b[:300]  # every distance twice
    keys = np.arange(600)
    q, qk = b[100:200], keys[100:200]
    r, c, d = _near(qk, q, keys, b, 5, skip)
    want = np.round(np.array([np.sqrt(((b - v) ** 2).sum(axis=1)) for v in q]), 9)
    if skip:
        want[qk[:, None] == keys[None, :]] = np.inf
    near = np.argsort(want, axis=1, kind="stable")[:, :5]
    assert (r.reshape(100, 5) == np.arange(100)[:, None]).all() and (c.reshape(100, 5) == near).all()
    assert (d.reshape(100, 5) == np.take_along_axis(want, near, 1)).all()


def test_short_blocks_and_bad_values():
    b = np.array([[0.0, 0.0], [np.nan, 1.0], [3.0, 4.0]])
    r, c, d = _near(np.array([9]), np.array([[0.0, 0.0]]), np.arange(3), b, 5, False)
    assert c.tolist() == [0, 2] and d.tolist() == [0.0, 5.0]
