"""Word shingles of batches of texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of the ASCII-lower-cased texts, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets -= offsets[0]
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    encoded = words.dictionary_encode()
    distinct = encoded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    counts = np.diff(np.concatenate([[0], np.cumsum(full)])[offsets])
    return hashes[codes[full]], counts


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and how many each has.

    A text of fewer words than ``width`` has its whole word sequence as one shingle; one without words has none.
    """
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    starts = ends - counts
    n = np.maximum(counts - width + 1, (counts > 0).astype(counts.dtype))
    rolled = np.zeros(len(words), np.uint64)
    for j in range(width):
        rolled[: len(words) - j] = rolled[: len(words) - j] * _STEP + words[j:] if j else words * _STEP
    rolled = _mix(rolled)
    sets, sizes = [], np.zeros(len(counts), np.int64)
    for i, (a, m, k) in enumerate(zip(starts.tolist(), counts.tolist(), n.tolist())):
        if not k:
            continue
        if m < width:
            h = np.uint64(m)
            for w in words[a : a + m]:
                h = np.uint64((int(h) * int(_STEP) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            found = _mix(np.array([h], np.uint64))
        else:
            found = np.sort(rolled[a : a + k])
            found = found[np.concatenate([[True], found[1:] != found[:-1]])]
        sets.append(found)
        sizes[i] = len(found)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes
