"""Reading a SentencePiece model file: its pieces, and the options that bear on segmentation.

The file is a protocol-buffer message; the few fields used here are read directly.

    ModelProto      1 pieces, 2 trainer_spec, 3 normalizer_spec
    SentencePiece   1 piece (string), 2 score (float), 3 type
    TrainerSpec     35 byte_fallback
    NormalizerSpec  1 name, 2 precompiled_charsmap, 3 add_dummy_prefix, 4 remove_extra_whitespaces, 5 escape_whitespaces
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            value, at = data[at : at + 8], at + 8
        yield key >> 3, value


@dataclass(frozen=True)
class PieceModel:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    byte_fallback: bool
    add_dummy_prefix: bool
    plain: bool  # texts are taken as they are: no character map, no white-space folding

    @classmethod
    def load(cls, path: str) -> PieceModel:
        pieces, scores, kinds = [], [], []
        fallback, prefix, folds, escapes, charsmap = False, True, True, True, b""
        with open(path, "rb") as f:
            data = f.read()
        for field, value in _fields(data):
            if field == 1:
                found = dict(_fields(value))
                pieces.append(found.get(1, b"").decode())
                scores.append(found.get(2, 0.0))
                kinds.append(found.get(3, NORMAL))
            elif field == 2:
                fallback = bool(dict(_fields(value)).get(35, 0))
            elif field == 3:
                found = dict(_fields(value))
                charsmap, prefix, folds, escapes = found.get(2, b""), bool(found.get(3, 1)), bool(found.get(4, 1)), bool(found.get(5, 1))
        return cls(tuple(pieces), tuple(scores), tuple(kinds), fallback, prefix, not charsmap and not folds and escapes)
