"""Batches of sequence texts as numpy arrays of base codes."""

from __future__ import annotations

import numpy as np

#: A C G T in either case are 0 to 3, any other byte is 4.
CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    CODE[ord(_c)] = CODE[ord(_c.lower())] = _i


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, each followed by one 4, and for each place the number of its text."""
    raw = [t.encode("utf-8") for t in texts]
    buf = CODE[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    return buf, np.repeat(np.arange(len(raw), dtype=np.int32), sizes + 1)


def packed(buf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the k letters from there on at 2 bits each (k <= 32), and whether all of them are A, C, G or T."""
    n = max(0, len(buf) - k + 1)
    out, done, size, part = np.zeros(n, np.uint64), 0, 1, (buf & 3).astype(np.uint64)
    while True:
        if k & size:
            out = (out << np.uint64(2 * size)) | part[done : done + n]
            done += size
        if done == k or size * 2 > k:
            break
        part = (part[:-size] << np.uint64(2 * size)) | part[size:]
        size *= 2
    bad = np.concatenate([[0], np.cumsum(buf == 4, dtype=np.int32)])
    return out, bad[k : k + n] == bad[:n]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit mix of 64-bit numbers (two multiply-xor-shift rounds)."""
    x = (x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x
