"""Exact counts of keys that are mostly unique, without shuffling a key alone.

Rows are dealt into chunks by a hash of their place, so equal rows do not meet. A chunk sorts its distinct keys, cuts them
into equal ranges and sends each range as one packed row: keys as byte planes of their differences, with the chunk's own
counts. The task of a range merges the rows of all chunks and answers each with totals in the order of its keys, which
compress to a few bits. A key counts once per chunk however often it occurs, so no key is hot.

The numbers of chunks and of ranges both grow with the input, but a chunk asks at most `FAN` ranges, so packed rows grow in
proportion. Where there must be more ranges, a task for each range and group of chunks merges what `FAN` chunks ask of it,
asks finer ranges itself in the same way, and hands the answers down.

Words are hashed for a whole buffer at once: the sum of a random number per byte, times a power of an odd base for the
byte's place, modulo 2**64, as a difference of running sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, located, settle

#: The most ranges that one task asks. With chunks of 8 MB, one level of ranges serves 32 GB of text, two serve 130 TB.
FAN = 4096

BASE = 0x9E3779B97F4A7C15
MIX = (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
#: A random number per byte value.
BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The six ASCII white-space characters.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray, by: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(by)
        return x ^ (x >> np.uint64(29))


def powers(n: int) -> list[np.ndarray]:
    """At least `n` powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for i, p in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            row = np.full(size, p, np.uint64)
            row[0] = 1
            _powers[i] = np.cumprod(row, dtype=np.uint64)
    return _powers


def _buffer(data: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(data, np.uint8)
    white = WHITE[b]
    edge = np.diff(white.view(np.int8), prepend=1, append=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(b) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(BYTES[b] * up[: len(b)], out=total[1:])
        h = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64), MIX[0])
    return h, np.diff(np.searchsorted(start, cuts))


def word_hashes(texts: list[bytes], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in a row, and the number of words of each text.

    A-Z count as a-z; words end at ASCII white space. Texts are joined into buffers of about `most` bytes.
    """
    forget()
    hashes, numbers = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    i = 0
    while i < len(texts):
        held, j = len(texts[i]), i + 1
        while j < len(texts) and held + len(texts[j]) + 1 <= most:
            held += len(texts[j]) + 1
            j += 1
        own = texts[i:j]
        cuts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in own])])
        h, n = _buffer(b"\n".join(own).lower(), cuts)
        hashes.append(h)
        numbers.append(n)
        i = j
    return np.concatenate(hashes), np.concatenate(numbers)


def planes(values: np.ndarray, kind: str) -> bytes:
    width = np.dtype(kind).itemsize
    return zstandard.compress(np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(-1, width).T).tobytes(), 1)


def from_planes(blob: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(flat.T).view(kind).reshape(-1)


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys."""
    return planes(np.diff(keys, prepend=np.uint64(0)), "<u8")


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(from_planes(blob, "<u8"), dtype=np.uint64)


def counts_packed(counts: np.ndarray) -> bytes:
    wide = len(counts) > 0 and int(counts.max()) >= 1 << 32
    return (b"8" if wide else b"4") + planes(counts, "<u8" if wide else "<u4")


def counts_unpacked(blob: bytes) -> np.ndarray:
    return from_planes(blob[1:], f"<u{blob[:1].decode()}").astype(np.int64)


def split(keys: np.ndarray, bits: int, parts: int) -> list[tuple[int, int, int]]:
    """(range, begin, end) of each of `parts` equal ranges of `bits`-bit keys that the sorted keys fall into."""
    kept = min(bits, 40)
    own = ((keys >> np.uint64(bits - kept)) * np.uint64(parts)) >> np.uint64(kept)
    begin = np.flatnonzero(np.diff(own, prepend=own[:1] + np.uint64(1)))
    return [(int(own[a]), int(a), int(b)) for a, b in zip(begin, [*begin[1:], len(keys)])]


#: A request: sorted distinct keys of a kind that fall into a range, with two counts of each. `want` says which totals to
#: give: the sum of both, the first, or each by itself.
ASK = "range long, chunk long, kind int, want int, keys binary, a binary, b binary"
SUM, FIRST, EACH = 0, 1, 2
#: An answer: totals in the order of the request's keys. Rows without a chunk hold sums over a whole range.
REPLY = "chunk long, kind int, range long, a binary, b binary, sums array<long>"
_ASK_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
_REPLY_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))


def as_table(rows: list[tuple], schema: str, types: tuple) -> pa.Table:
    names = [x.split(" ")[0] for x in schema.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types, strict=True))})


def asked(chunk: int, kind: int, want: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray | None, bits: int, parts: int) -> list[tuple]:
    """The requests of a chunk for its sorted distinct keys of one kind."""
    return [(r, chunk, kind, want, packed(keys[x:y]), counts_packed(a[x:y]), None if b is None else counts_packed(b[x:y])) for r, x, y in split(keys, bits, parts)]


def asks(rows: list[tuple]) -> pa.Table:
    return as_table(rows, ASK, _ASK_TYPES)


def by_kind(table: pa.Table):
    """kind, its requests, the distinct keys of all of them, each request's places among those, and the totals."""
    rows = table.to_pylist()
    for kind in sorted({r["kind"] for r in rows}):
        own = sorted((r for r in rows if r["kind"] == kind), key=lambda r: (r["range"], r["chunk"]))
        keys = [unpacked(r["keys"]) for r in own]
        unique, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = []
        for name in ("a", "b"):
            each = [np.zeros(len(k), np.int64) if r[name] is None else counts_unpacked(r[name]) for r, k in zip(own, keys, strict=True)]
            sums.append(np.bincount(place, np.concatenate(each), len(unique)).astype(np.int64))
        yield kind, own, unique, np.split(place, np.cumsum([len(k) for k in keys])[:-1]), sums


def answers(own: list[dict], places: list[np.ndarray], sums: list[np.ndarray]) -> list[tuple]:
    a, b = sums
    out = []
    for r, p in zip(own, places, strict=True):
        first = counts_packed((a + b)[p] if r["want"] == SUM else a[p])
        out.append((r["chunk"], r["kind"], r["range"], first, counts_packed(b[p]) if r["want"] == EACH else None, None))
    return out


def exchange(requests: DataFrame, bits: dict[int, int], many: int, parts: int, skip: tuple[int, np.uint64] | None = None, fan: int = FAN) -> DataFrame:
    """Answers to `requests` (ASK), whose keys of each kind have so many `bits` and are cut into `parts` ranges; `many` ranges
    are needed. With `skip`, a kind and a key, there is one more row for each range of that kind: the sum of both counts,
    the number of keys of any count and the sum of the first count, over all keys but that one."""

    def leaf(table: pa.Table) -> pa.Table:
        out = []
        for kind, own, unique, places, (a, b) in by_kind(table):
            out += answers(own, places, [a, b])
            if skip is not None and kind == skip[0]:
                other = unique != skip[1]
                out.append((None, kind, own[0]["range"], None, None, [int((a + b)[other].sum()), int(((a + b)[other] > 0).sum()), int(a[other].sum())]))
        return as_table(out, REPLY, _REPLY_TYPES)

    if parts >= many:
        return requests.groupBy("range").applyInArrow(leaf, REPLY)
    groups = -(-many // parts)
    finer = parts * min(fan, groups)
    noded = settle(requests).withColumn("node", F.col("range") * F.lit(groups) + F.pmod(F.xxhash64("chunk"), F.lit(groups)))

    def up(table: pa.Table) -> pa.Table:
        node = table.column("node")[0].as_py()
        return asks([row for kind, _, unique, _, sums in by_kind(table) for row in asked(node, kind, EACH, unique, *sums, bits[kind], finer)])

    def down(table: pa.Table, given: pa.Table) -> pa.Table:
        found = sorted(given.to_pylist(), key=lambda r: r["range"])
        out = []
        for kind, own, unique, places, _ in by_kind(table) if table.num_rows else ():
            sums = [np.concatenate([counts_unpacked(r[name]) for r in found if r["kind"] == kind]) for name in ("a", "b")]
            if len(sums[0]) != len(unique):
                raise RuntimeError("the answers do not fit the requests")
            out += answers(own, places, sums)
        return as_table(out, REPLY, _REPLY_TYPES)

    above = settle(exchange(noded.groupBy("node").applyInArrow(up, ASK), bits, many, finer, skip, fan))
    below = noded.groupBy("node").cogroup(above.where("chunk is not null").groupBy("chunk")).applyInArrow(down, REPLY)
    return below.unionByName(above.where("chunk is null"))


def chunked(docs: DataFrame, text: str, chunk_bytes: int, *columns: Column) -> tuple[int, DataFrame]:
    """How many chunks of about `chunk_bytes` of text there are; and `columns` with the `chunk` of each row and `_row`."""
    size = docs.agg(F.sum(F.octet_length(F.col(text)) + 8)).first()[0] or 0
    many = max(1, -(-size // chunk_bytes))
    rows = located(docs, *columns)
    return many, rows.withColumn("chunk", F.pmod("_row", F.lit(many)))
