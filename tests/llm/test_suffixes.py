"""The suffix array kernel against sorting."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from candlemill.llm import suffixes
from candlemill.llm.suffixes import Prefix, common_prefixes, induce, induce_each, small_types, suffix_array


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.booleans())
def test_order_and_prefixes(symbols, twice):
    t = np.array([*symbols, *(symbols if twice else []), 0])
    prefix = Prefix(t)
    sa = suffix_array(t, 8)
    want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert sa.tolist() == want
    shared = common_prefixes(t, sa, prefix)
    for a, b in zip(want, want[1:], strict=False):
        n = 0
        while a + n < len(t) and b + n < len(t) and t[a + n] == t[b + n]:
            n += 1
        assert shared[b] == n


@pytest.mark.parametrize("sigma", [5, 400])
def test_larger_texts_recurse(sigma, monkeypatch):
    """Repeats of long strings need several levels; both scans give the same array."""
    r = np.random.default_rng(sigma)
    part = r.integers(1, sigma, 700)
    t = np.concatenate([part, r.integers(1, sigma, 300), part, part[:500], np.ones(200, np.int64), part, [0]])
    depth = []
    monkeypatch.setattr(suffixes, "small_types", lambda x: (depth.append(len(x)), small_types(x))[1])
    sa = suffix_array(t, sigma)
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist()) and len(depth) > 2
    small = small_types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    assert induce(t, small, lms, sigma).tolist() == induce_each(t, small, lms, sigma).tolist()


def test_equal_hashes_do_not_pass_for_equal_symbols():
    t = np.array([3, 1, 2, 3, 1, 2, 3, 0])
    got = np.array([4, 2])
    suffixes.confirm(t, np.array([0, 1]), np.array([3, 2]), got)
    assert got.tolist() == [4, 0]
