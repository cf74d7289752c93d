"""Buckets of sorted hashes."""

import numpy as np
import pytest

from shelfspark.llm import exchange as X


@pytest.mark.parametrize("buckets", [1, 3, 1000, 400_000])
def test_only_buckets_that_get_hashes_are_packed(buckets):
    h = np.sort(np.random.default_rng(buckets).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    cuts = X.bounds(h, buckets)
    assert np.repeat(cuts.buckets, np.diff(cuts.edges)).tolist() == [(int(x) >> 32) * buckets >> 32 for x in h]
    rows = X.pack(7, 0, cuts, h)
    assert len(rows) == len(set(cuts.buckets)) <= min(buckets, 5000)
    assert np.array_equal(np.concatenate([X.unpack(r["packed"], np.uint64)[0] for r in rows]), h)


def test_no_hashes():
    cuts = X.bounds(np.zeros(0, np.uint64), 5)
    assert X.pack(1, 0, cuts, np.zeros(0, np.uint64)) == [] and not len(X.bits([], cuts))
