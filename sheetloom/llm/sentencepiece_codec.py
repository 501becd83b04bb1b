"""SentencePiece encoding and decoding by a streaming search with backpointers.

A text is read once. For every position the best piece that ends there is kept as a backpointer, in a window bounded by
the longest piece: only its last `longest` positions can still start a piece. Whenever the backpointer paths of all of
them meet in one boundary, the ids up to that boundary are final and are committed, and the window starts there. No piece
holds a space mark behind another character, so before every run of spaces all paths meet at once; what lies between
two such boundaries is looked up in a bounded cache first.

Which piece survives at a position depends on the kind of model. Unigram: the one with the best summed score, the ordinary
Viterbi recursion. BPE: merges are no sum of scores, so a plain Viterbi search would give other ids than the library.
There a segmentation is the library's exactly if every two neighbouring pieces stay apart when their joined text is merged
by itself; hence exactly one piece can end at each position, and that one survives.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Cache, as_bytes, kept, pieces, widened
from .token_counts import crossing_pieces, load_model, units

SPACE = "▁"


class Codec:
    """A model's vocabulary; `kind` is "bpe" or "unigram"."""

    def __init__(self, pieces: dict[str, int], scores: dict[str, float], byte_ids: list[int], kind: str = "bpe", most_pairs: int = 400_000):
        self.pieces, self.scores, self.byte_ids, self.kind = pieces, scores, byte_ids, kind
        self.longest = max(map(len, pieces))
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.parts: dict[str, bytes] = {}
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.pairs: dict[tuple[str, str], bool] = {}
        self.reachable = {p for p in pieces if kind == "unigram" or self.merged(p) == [p]}
        self.most_pairs = most_pairs

    @classmethod
    def of(cls, model, kind: str = "bpe") -> Codec:
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): i for i in plain}
        found = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        byte_ids = [i if model.is_byte(i) else model.unk_id() for i in found]
        return cls(pieces, {p: model.get_score(i) for p, i in pieces.items()}, byte_ids, kind)

    def merged(self, text: str) -> list[str]:
        """Merge the best-scored neighbours, leftmost first among equals, until none of them forms a piece."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, left: str, right: str) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return found

    def emit(self, piece: str) -> list[int]:
        """The piece's id; the ids of its bytes if it is no piece."""
        found = self.pieces.get(piece)
        return [found] if found is not None else [self.byte_ids[b] for b in piece.encode()]

    def stream(self, chars: Iterable[str]) -> Iterator[int]:
        """Commit ids as soon as every path that can still be extended goes through one boundary.

        `window` is what was read behind the last boundary but one; `last` has for each position in it the start of the piece
        that survives there, `ends` that piece, `best` its summed score. It holds at most `bound` characters.
        """
        bpe, longest, reachable, pairs, scores = self.kind == "bpe", self.longest, self.reachable, self.pairs, self.scores
        window, size, done, due, last, ends, best = "", 0, 0, 2 * self.longest, [0], [""], [0.0]
        for c in chars:
            window += c
            size += 1
            start, piece = size - 1, c  # a single character, known or not
            if bpe:
                for j in range(size - longest if size > longest else 0, size - 1):
                    longer = window[j:size]
                    if longer in reachable:
                        if not j:
                            start, piece = j, longer
                            break
                        found = pairs.get((ends[j], longer))
                        if found or found is None and self.apart(ends[j], longer):
                            start, piece = j, longer
                            break
            else:
                top = best[start] + scores.get(c, self.unknown)
                for j in range(size - longest if size > longest else 0, size - 1):
                    longer = window[j:size]
                    s = scores.get(longer)
                    if s is not None and best[j] + s > top:
                        start, piece, top = j, longer, best[j] + s
                best.append(top)
            last.append(start)
            ends.append(piece)
            if size == due:
                cut = self.meeting(last, size - longest + 1)
                if cut > done:
                    yield from self.path(last, ends, done, cut)
                    # pieces to come start at the cut or later; the piece before it still bears on which of them survive
                    gone, base = last[cut], 0.0 if bpe else best[cut]
                    window, size, done = window[gone:], size - gone, cut - gone
                    last, ends, best = [max(0, x - gone) for x in last[gone:]], ends[gone:], [x - base for x in best[gone:]]
                if size > self.bound:
                    raise RuntimeError("the paths of this vocabulary do not meet within the window")
                due = size + longest
        yield from self.path(last, ends, done, size)

    @property
    def bound(self) -> int:
        """Characters that the window may hold. In a model of the BPE kind paths need not meet soon in theory; they do."""
        return 64 * self.longest

    @staticmethod
    def meeting(last: list[int], first: int) -> int:
        """The largest boundary that the paths from `first` to the end have in common."""
        alive = set(range(first, len(last)))
        while len(alive) > 1:
            alive.discard(top := max(alive))
            alive.add(last[top])
        return alive.pop()

    def path(self, last: list[int], ends: list[str], done: int, end: int) -> list[int]:
        """Ids of the pieces on the path from `done` to `end`."""
        found = []
        while end > done:
            found.append(ends[end])
            end = last[end]
        ids = self.pieces
        return [t for p in reversed(found) for t in ((ids[p],) if p in ids else self.emit(p))]

    def encode_unit(self, unit: bytes) -> bytes:
        """Ids of a pre-token as 32-bit numbers: its parts are streamed. Where no piece has two neighbouring characters in a
        row, all paths meet, and a part ends."""
        text = SPACE + unit.decode().replace(" ", SPACE)
        cuts = [0, *(i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.joined), len(text)]
        out = []
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 24:
                out.append(array("I", self.stream(islice(text, a, b))).tobytes())
                continue
            part = text[a:b]
            ids = self.parts.get(part)
            if ids is None:
                if len(self.parts) >= self.most_pairs:
                    self.parts.clear()
                ids = self.parts[part] = array("I", self.stream(part)).tobytes()
            out.append(ids)
        return b"".join(out)


def cached(model_path: str, kind: str, cache_size: int) -> Cache:
    """Ids of pre-tokens as 32-bit numbers in bytes; kept by a Python worker from task to task."""

    def make() -> Cache:
        codec = Codec.of(load_model(model_path), kind)
        return Cache(lambda ws: [codec.encode_unit(w) for w in ws], cache_size)

    return kept(("sentencepiece", model_path, kind, cache_size), make)


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", cache_size: int = 800_000, kind: str = "bpe") -> DataFrame:
    """Add `ids`, the token ids of each whole text, without begin or end ids.

    Null gives null, an empty text no ids. Besides the text and its ids a search holds one window, whose length is bounded.
    Repeated rows are encoded each, null keys like others. All other columns pass through, whatever their names; `ids`
    replaces a column of that name. An empty table gives an empty table.
    """
    rest = [c for c in docs.columns if c != ids]
    plain = docs.select(*(F.col(f"`{c}`") for c in rest))
    at = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cached(model_path, kind, cache_size)
        for batch in (part for whole in batches for part in pieces(whole, at, 2 << 20)):
            lists = [None if t is None else units(t) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            table = cache.lookup(set(chain.from_iterable(u for u in lists if u)))
            out = [None if u is None else array("i", b"".join(map(table.__getitem__, u))) for u in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*rest, ids])

    return plain.mapInArrow(run, widened(plain).add(ids, T.ArrayType(T.IntegerType())))


def digest(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", cache_size: int = 800_000, kind: str = "bpe") -> DataFrame:
    """Per document: key, n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers), and whether decoding the ids
    gives the text again, in which a space mark reads as a space. A null text counts as empty; null keys and repeated rows
    each give their row, other columns are left out, and an empty table gives no rows."""
    from zlib import crc32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, spelled = cached(model_path, kind, cache_size), decoder(load_model(model_path))
        for batch in (part for whole in batches for part in pieces(whole, 1, 2 << 20)):
            n, crc, same = [], [], []
            texts = as_bytes(batch.column(1))
            lists = [units(t) for t in texts]
            table = cache.lookup(set(chain.from_iterable(lists)))
            for t, u in zip(texts, lists, strict=True):
                joined = b"".join(map(table.__getitem__, u))
                n.append(len(joined) // 4)
                crc.append(crc32(joined))
                same.append(spelled(array("I", joined)) == t.replace(SPACE.encode(), b" "))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], names=[key, "n_tokens", "ids_crc32", "round_trip"])

    plain = docs.select(F.col(key), F.col(text))
    schema = plain.select(key).schema.add("n_tokens", "long").add("ids_crc32", "long").add("round_trip", "boolean")
    return plain.mapInArrow(run, schema)


def decoder(model):
    """ids -> UTF-8 bytes: byte pieces are their byte, space marks are spaces, and the one space put before a text goes."""
    table = []
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            table.append(bytes([int(name[3:5], 16)]))
        elif model.is_control(i):
            table.append(b"")
        else:
            table.append(name.replace(SPACE, " ").encode())
    spell = table.__getitem__
    return lambda ids: b"".join(map(spell, ids))[1:]


def decode(tokens: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add `text`, the text of the ids. Null gives null, no ids an empty text; an id outside the vocabulary raises.

    All other columns pass through; `text` replaces a column of that name.
    """
    rest = [c for c in tokens.columns if c != text]
    plain = tokens.select(*(F.col(f"`{c}`") for c in rest))
    at = rest.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = decoder(load_model(model_path))
        for batch in batches:
            out = [None if x is None else spelled(x).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*rest, text])

    return plain.mapInArrow(run, widened(plain).add(text, "string"))
