"""ISO base media containers: writing, walking boxes, decoding sample tables.

``mux`` stores bytes as one track of unsigned 8-bit mono samples:

    ftyp
    moov > mvhd, trak > tkhd, mdia > mdhd, hdlr, minf > smhd, dinf > dref, stbl > stsd, stts, stsc, stsz, stss, stco
    mdat

Samples of a fixed number of payload bytes are grouped in chunks; every sample that
begins a chunk is a sync sample.  ``tracks`` reads any such file: it walks the nested
boxes and decodes the sample tables of each track (stts, stsc, stsz, stss, stco or co64)
into codec, duration and the byte range and time of each keyframe, and never touches the
payload.  Tables are checked against the size of their box before they are read and are
decoded with numpy.

Defined results: a null or empty text is stored as one block of zeros; repeated rows get
the same values; a null, cut-off or forged container has null columns; other columns are
not looked at, and names they take are avoided; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_texts, free_name

SAMPLE, CHUNK, RATE, PAD = 64, 16, 8000, 64
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def mux(payload: bytes, sample: int = SAMPLE, per_chunk: int = CHUNK, rate: int = RATE) -> bytes:
    """A container with the payload as 8-bit samples; its length must be a multiple of ``sample``."""
    if len(payload) % sample:
        raise ValueError("pad the payload to whole samples")
    n, duration = len(payload) // sample, len(payload)
    chunks = -(-n // per_chunk)
    last = n - (chunks - 1) * per_chunk
    runs = [(1, per_chunk, 1)] if chunks > 1 or last == per_chunk else []
    if chunks and last != per_chunk:
        runs.append((chunks, last, 1))
    entry = _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, rate << 16))
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")

    def moov(first: int) -> bytes:
        starts = [first + c * per_chunk * sample for c in range(chunks)]
        offsets = _full(b"co64", struct.pack(f">I{chunks}Q", chunks, *starts)) if first + duration >= 1 << 32 else _full(b"stco", struct.pack(f">I{chunks}I", chunks, *starts))
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, sample)),
            _full(b"stss", struct.pack(f">I{chunks}I", chunks, *range(1, n + 1, per_chunk))),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            _full(b"stsz", struct.pack(">II", sample, n)),
            offsets,
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, duration, 0x55C4, 0)),
            _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"payload\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
        )
        head = _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, duration, 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=3)
        movie = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, rate, duration, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", movie, _box(b"trak", head, media))

    data = _box(b"mdat", payload)
    first = len(ftyp) + len(moov(0)) + len(data) - len(payload)
    return ftyp + moov(first) + data


def boxes(data: bytes) -> Iterator[tuple[int, bytes, int, int]]:
    """(depth, kind, body begin, body end) of every box, nested ones after their parent; a stack, so any depth will do."""
    stack = [(0, 0, len(data))]
    while stack:
        depth, begin, end = stack.pop()
        if begin + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, begin)
        head = 8
        if size == 1:
            if begin + 16 > end:
                raise ValueError("box header cut off")
            size, head = struct.unpack_from(">Q", data, begin + 8)[0], 16
        elif size == 0:
            size = end - begin
        if size < head or begin + size > end:
            raise ValueError(f"box {kind!r} of {size} bytes does not fit")
        yield depth, kind, begin + head, begin + size
        stack.append((depth, begin + size, end))
        if kind in _NESTED:
            stack.append((depth + 1, begin + head, begin + size))


def _entries(data: bytes, span: tuple[int, int], code: str, width: int = 1, skip: int = 4) -> np.ndarray:
    """The counted entries of a table box, one row each; the count is checked against the box before anything is read."""
    begin, end = span[0] + skip, span[1]
    if begin + 4 > end:
        raise ValueError("table cut off")
    n, size = struct.unpack_from(">I", data, begin)[0], np.dtype(code).itemsize
    if n * width * size > end - begin - 4:
        raise ValueError(f"table claims {n} entries")
    return np.frombuffer(data, code, n * width, begin + 4).astype(np.int64).reshape(n, width)


def _times(data: bytes, at: dict[bytes, tuple[int, int]], samples: int) -> np.ndarray:
    """Decoding time of each sample and of the end, in units of the timescale (``stts``)."""
    runs = _entries(data, at[b"stts"], ">u4", 2)
    if (runs[:, 0] < 0).any() or int(runs[:, 0].sum()) != samples:
        raise ValueError("stts does not cover the samples")
    return np.concatenate([[0], np.cumsum(np.repeat(runs[:, 1], runs[:, 0]))])


def _sizes(data: bytes, span: tuple[int, int], most: int) -> np.ndarray:
    """Sizes of the samples (``stsz``); samples of one size need no table, so their total is checked against the file."""
    fixed, n = struct.unpack_from(">II", data, span[0] + 4)
    if fixed:
        if fixed * n > most:
            raise ValueError(f"{n} samples of {fixed} bytes exceed the file")
        return np.full(n, fixed, np.int64)
    return _entries(data, span, ">u4", skip=8)[:, 0]


def _track(data: bytes, at: dict[bytes, tuple[int, int]]) -> dict:
    """What the sample tables of one track say."""
    wide = data[at[b"mdhd"][0]] == 1
    scale, duration = struct.unpack_from(">IQ" if wide else ">II", data, at[b"mdhd"][0] + (20 if wide else 12))
    codec = struct.unpack_from(">4s", data, at[b"stsd"][0] + 12)[0].decode("latin-1")
    sizes = _sizes(data, at[b"stsz"], len(data))
    n = len(sizes)
    chunks = (_entries(data, at[b"co64"], ">i8") if b"co64" in at else _entries(data, at[b"stco"], ">u4"))[:, 0]
    runs = _entries(data, at[b"stsc"], ">u4", 3)
    if n and (not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(chunks)):
        raise ValueError("stsc does not fit the chunks")
    each = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1))) if len(runs) else np.zeros(0, np.int64)
    if int(each.sum()) != n:
        raise ValueError("stsc does not cover the samples")
    upto = np.concatenate([[0], np.cumsum(sizes)])
    firsts = np.cumsum(each) - each  # first sample of each chunk
    lengths = upto[firsts + each] - upto[firsts]
    starts = upto[:-1] + np.repeat(chunks - upto[firsts], each)
    if n and (chunks.min() < 0 or (chunks + lengths).max() > len(data)):
        raise ValueError("samples outside the file")
    times = _times(data, at, n)
    sync = _entries(data, at[b"stss"], ">u4")[:, 0] - 1 if b"stss" in at else np.arange(n)
    if len(sync) and (sync.min() < 0 or sync.max() >= n):
        raise ValueError("stss names a sample that is not there")
    return {
        "codec": codec,
        "timescale": scale,
        "duration": duration if duration else int(times[-1]),
        "samples": n,
        "ranges": list(zip(chunks.tolist(), (chunks + lengths).tolist())),
        "keyframes": list(zip(starts[sync].tolist(), (starts + sizes)[sync].tolist())),
        "key_times": times[sync].tolist(),
    }


def tracks(data: bytes) -> list[dict]:
    """Every track of a file: codec, timescale, duration (of the header, else of the sample times), number of samples,
    byte ranges of the chunks, byte ranges and times of the keyframes.  Edit lists and composition offsets are not applied.
    """
    found: list[dict[bytes, tuple[int, int]]] = []
    inside = -1
    for depth, kind, begin, end in boxes(data):
        if depth <= inside:
            inside = -1
        if kind == b"trak" and inside < 0:
            found.append({})
            inside = depth
        elif inside >= 0:
            found[-1].setdefault(kind, (begin, end))
    return [_track(data, at) for at in found]


def describe(data: bytes) -> dict:
    """The first track; KeyError, ValueError or struct.error for what cannot be read."""
    found = tracks(data)
    if not found:
        raise ValueError("no track")
    return found[0]


_LONG, _STRING, _SECONDS = pa.int64(), pa.string(), pa.float64()
_SPANS = pa.list_(pa.struct([("begin", _LONG), ("end", _LONG)]))
MEDIA = "struct<n_bytes:long,payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,feature:string,codec:string,duration_s:double,keyframes:array<struct<begin:long,end:long>>>"
_MEDIA = pa.struct([("n_bytes", _LONG), ("payload_bytes", _LONG), ("payload_sha256", _STRING), ("tail_crc32", _LONG), ("media_bytes", _LONG), ("media_sha256", _STRING), ("feature", _STRING), ("codec", _STRING), ("duration_s", _SECONDS), ("keyframes", _SPANS)])
TRACKS = "array<struct<codec:string,duration_s:double,keyframes:array<struct<begin:long,end:long>>>>"
_TRACKS = pa.list_(pa.struct([("codec", _STRING), ("duration_s", _SECONDS), ("keyframes", _SPANS)]))


def _columns(found: dict) -> dict:
    return {"codec": found["codec"], "duration_s": found["duration"] / (found["timescale"] or 1), "keyframes": [{"begin": a, "end": b} for a, b in found["keyframes"]]}


def stored_media(text: Column) -> Column:
    """Stores each text as a container, reads the stored bytes back, and describes them; null counts as empty.

    codec, duration_s and keyframes come from the walk of the stored boxes.  feature is
    codec:timescale:duration:samples:keyframes:digest of the keyframe byte ranges and times.
    """

    @F.arrow_udf(MEDIA)
    def store(column: pa.Array) -> pa.Array:
        rows = []
        for t in as_texts(column).to_pylist():
            raw = t.encode()
            media = mux(raw + bytes(-len(raw) % PAD or (PAD if not raw else 0)))
            found = describe(media)
            payload = b"".join(media[a:b] for a, b in found["ranges"])
            keys = hashlib.sha256(",".join(f"{a}-{b}@{t}" for (a, b), t in zip(found["keyframes"], found["key_times"])).encode()).hexdigest()[:16]
            feature = ":".join(map(str, (found["codec"], found["timescale"], found["duration"], found["samples"], len(found["keyframes"]), keys)))
            digests = {"payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-PAD:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}
            rows.append({"n_bytes": len(raw), "payload_bytes": len(payload), **digests, "feature": feature, **_columns(found)})
        return pa.array(rows, _MEDIA)

    return store(text)


def media_columns(df: DataFrame, media: str) -> DataFrame:
    """All rows and columns plus codec, duration_s and keyframes (array of begin and end) of a binary column, and tracks with the same of every track.

    The first three are those of the first track.  Null and unreadable containers get nulls, whatever is wrong with them.
    """

    @F.arrow_udf(TRACKS)
    def read(column: pa.Array) -> pa.Array:
        rows = []
        for data in column.to_pylist():
            try:
                rows.append([_columns(t) for t in tracks(data)] or None if data is not None else None)
            except (KeyError, ValueError, IndexError, OverflowError, struct.error):
                rows.append(None)
        return pa.array(rows, _TRACKS)

    found = free_name(df, "found")
    first = F.get(found, 0)
    named = [first[c].alias(free_name(df, c)) for c in ("codec", "duration_s", "keyframes")]
    return df.withColumn(found, read(F.col(media))).select(*[df[c] for c in df.columns], *named, F.col(found).alias(free_name(df, "tracks")))


def media_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and what ``stored_media`` says of each row's whole text."""
    found = free_name(docs, "found")
    return docs.withColumn(found, stored_media(F.col(text))).select(F.col(doc_id).alias("doc_id"), f"{found}.*")
