"""Recall of the cap filters at every code size."""

import numpy as np
import pytest

from pairforge.llm import cap_filters


@pytest.mark.parametrize("codes", [64, 256, 1024, 2048, 4096])
def test_pairs_at_the_threshold_meet_at_every_code_size(codes):
    rng = np.random.default_rng(21)
    x = rng.standard_normal((250, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    pairs = zip(cap_filters.decode(x, codes), cap_filters.decode(y, codes), strict=True)
    assert all(np.intersect1d(a, b).size for a, b in pairs)
    # Three codes, as there once were, miss more than is allowed here.
    assert cap_filters.rotations(64, codes) > 3


@pytest.mark.parametrize("n", [64, 2000, 20_000, 200_000])
def test_strangers_seldom_share_a_bucket(n):
    """Rows that would be sent for a random vector because somebody shares one of its buckets, at ten labels."""
    rng = np.random.default_rng(4)
    codes = cap_filters.codes_for(n)
    here = n // 10  # of one label
    sample = min(here, 4000)
    x = rng.standard_normal((sample, 64))
    caps = cap_filters.decode(x / np.linalg.norm(x, axis=1, keepdims=True), codes)
    _, place, count = np.unique(np.concatenate(caps), return_inverse=True, return_counts=True)
    # A bucket is shared with a chance that grows with the vectors left out of the sample.
    others = (count[place] - 1) * max(1.0, here / max(sample, 1))
    assert np.minimum(others, 1).sum() / max(len(caps), 1) < 10
