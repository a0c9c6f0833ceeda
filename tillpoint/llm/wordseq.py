"""Documents of a bucket as one flat sequence of word numbers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


@dataclass
class Words:
    """``code[i]``: number of word i in ``vocab``; ``off``: where each
    document's words begin in the flat sequence (one more entry at the end)."""

    code: np.ndarray
    off: np.ndarray
    vocab: pa.Array
    flat: pa.Array

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def split_words(texts: pa.Array) -> Words:
    """Words between runs of space and \\t..\\r, unchanged; a null has none."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    flat = lists.flatten()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    count = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    off = np.r_[0, np.cumsum(np.bincount(np.repeat(np.arange(len(count)), count)[real], minlength=len(count)))]
    flat = flat.filter(pa.array(real))
    enc = flat.dictionary_encode()
    return Words(enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), off.astype(np.int64), enc.dictionary, flat)


def word_hashes(vocab: pa.Array) -> np.ndarray:
    """Two independent 64-bit hashes of every word."""
    raw = b"".join(map(xxhash.xxh3_128_digest, vocab.cast(pa.large_binary()).to_pylist()))
    return np.frombuffer(raw, "<u8").reshape(-1, 2).copy()


def sequence_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every ``k`` consecutive word hashes."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[j:j + n]
    return out


def whole(off: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of ``n`` starts have ``k`` words in one document."""
    ok = np.ones(n, bool)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        ok[max(a, b - k + 1):b] = False
    return ok
