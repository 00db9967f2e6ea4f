import numpy as np

from strandforge.llm import neardup


def test_pairs_at_the_threshold_share_a_band():
    rng = np.random.default_rng(0)
    for _ in range(6):
        # 40 substrings each, 30 in common: a similarity of exactly 0.6
        raw = np.frombuffer(b"ACGT", np.uint8)[rng.integers(0, 4, (10_000, 61))]
        n = len(raw)
        texts = [bytes(r[:51]).decode() for r in raw] + [bytes(r[10:]).decode() for r in raw]
        who, keys = neardup.band_keys(texts, np.zeros(2 * n, np.int64))
        keys = keys[np.argsort(who, kind="stable")].reshape(2 * n, -1)
        assert (keys[:n] == keys[n:]).any(axis=1).all()
