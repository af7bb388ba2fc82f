"""Batched token ids of a public ``tokenizers`` vocabulary.

White space always ends a pre-token of the word vocabulary, so the ids of a text
are the ids of its white-space chunks in order.  Chunks repeat, so each distinct
one is encoded by the library once and remembered; the ids of a slice of texts are
then gathered with numpy.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks of these characters only are lower-cased and cut at punctuation before encoding: no apostrophes
#: (contractions are one pre-token), nothing above U+00FF (no combining marks).  U+0130 is lower-cased to one of them
#: here but to two characters by the library, so chunks that hold it are never simple, nor are chunks that hold the
#: text of an added token, which the library takes as that token.
_SIMPLE = r"^[a-z0-9\x{DF}-\x{F6}\x{F8}-\x{FF}!-&(-/:-@\[-`{-~]*$"
_LETTERS = r"^[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+$"
_PUNCTUATION = r"([!-&(-/:-@\[-`{-~]+)"
_JOIN = 256


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each range, one after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()), dtype=starts.dtype)


class BatchTokenizer:
    """Encodes slices of texts; remembers at most twice ``memo`` distinct words."""

    def __init__(self, path: str, memo: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, i in vocabulary.items():
            self.ends[i] = piece.endswith("</w>")
        self.memo, self.young, self.old = memo, {"": b""}, {}

    def _learn(self, words: list[str], joined: bool) -> None:
        """Encodes new words; ``joined``: they are letters only, so each ends with the only piece that has the end mark."""
        if not joined:
            for word, found in zip(words, self.library.encode_batch_fast(words, add_special_tokens=False)):
                self.young[word] = np.array(found.ids, np.uint32).tobytes()
            return
        groups = [words[i : i + _JOIN] for i in range(0, len(words), _JOIN)]
        for group, found in zip(groups, self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(group):
                self._learn(group, False)
                continue
            raw, begin = ids.tobytes(), 0
            for word, cut in zip(group, cuts):
                self.young[word] = raw[4 * begin : 4 * cut]
                begin = cut

    def _lookup(self, words: pa.Array, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words: all ids, and how many each word has."""
        if len(self.young) > self.memo:
            self.old, self.young = self.young, {"": b""}
        names = words.to_numpy(zero_copy_only=False).tolist()
        young, old = self.young, self.old
        fresh: tuple[list, list] = ([], [])
        for word, plain in zip(names, letters.tolist()):
            if word not in young:
                known = old.get(word)
                if known is None:
                    fresh[plain].append(word)
                else:
                    young[word] = known
        for joined in (False, True):
            if fresh[joined]:
                self._learn(fresh[joined], joined)
        found = [young[w] for w in names]
        return np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) >> 2

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the count of each text.  A null text is empty."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        offsets = lists.offsets.to_numpy().astype(np.int64)
        chunks = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        codes = chunks.indices.to_numpy(zero_copy_only=False)
        distinct = chunks.dictionary
        lowered = pc.utf8_lower(distinct)
        own = pc.match_substring(distinct, "\u0130")
        for token in self.added:
            own = pc.or_(own, pc.match_substring(lowered, token))
        simple = pc.and_not(pc.match_substring_regex(lowered, _SIMPLE), own)
        # words of each distinct chunk: the chunk itself, or its parts where it is simple
        parts = pc.if_else(simple, pc.replace_substring_regex(lowered, _PUNCTUATION, r" \1 "), distinct)
        split = pc.split_pattern(parts, " ")
        at = split.offsets.to_numpy().astype(np.int64)
        words = split.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        letters = pc.match_substring_regex(words.dictionary, _LETTERS).to_numpy(zero_copy_only=False)
        flat, counts = self._lookup(words.dictionary, letters)
        begins = np.cumsum(counts) - counts
        word_codes = words.indices.to_numpy(zero_copy_only=False)
        word_counts = counts[word_codes]
        flat = flat[ragged(begins[word_codes], word_counts)]  # ids chunk by chunk
        ends = np.concatenate([[0], np.cumsum(word_counts)])[at - at[0]]
        chunk_counts = np.diff(ends)
        sizes = chunk_counts[codes]
        ids = flat[ragged(ends[:-1][codes].astype(np.int32), sizes.astype(np.int32))]
        total = np.concatenate([[0], np.cumsum(sizes)])[offsets - offsets[0]]
        return ids, np.diff(total)


_LOADED: dict[tuple[str, int], BatchTokenizer] = {}


def tokenizer(path: str, memo: int = 200_000) -> BatchTokenizer:
    """One per worker process and vocabulary file."""
    if (path, memo) not in _LOADED:
        _LOADED[path, memo] = BatchTokenizer(path, memo)
    return _LOADED[path, memo]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends one end id to each text's ids."""
    return np.insert(ids, np.cumsum(counts), np.uint32(end)), counts + 1
