"""Token counts by a map-side two-tier lookup, without any shuffle of pre-tokens.

Tier one is a compact table of the corpus' frequent pre-tokens and their token counts, broadcast once. Tier two is a cache
in each Python worker, filled by the tokenizer library for whatever the first tier misses. A pre-token is a run of spaces
with the run of other bytes behind it; `crossing_pieces` proves from the vocabulary that no piece reaches across such a
boundary, so the counts of the pre-tokens of a text add up to the count of the text.
"""

from __future__ import annotations

import pickle
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, as_bytes, kept, pieces, widened

UNIT = re.compile(rb" *[^ ]+| +$")
SPECIAL = b"\xe2\x96\x81"  # the mark that stands for a space inside pieces


def load_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def crossing_pieces(model) -> list[str]:
    """Pieces in which the space mark follows another character; pre-tokens may be counted alone only if there are none."""
    names = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return [p for p in names if "▁" in p.lstrip("▁")]


def counter(model):
    """Token counts of pre-tokens. A trailing space alone is one piece, though the library gives an empty text none."""
    return lambda words: [len(x) or 1 for x in model.encode([w.decode() for w in words], num_threads=1)] if words else []


def units(text: bytes) -> list[bytes]:
    """The pre-tokens of a text, each without the one space that the library puts before a text by itself.

    Plain words separated by one space are the common case; a literal space mark in the text counts as a space to the
    library, so it is made one first.
    """
    if SPECIAL in text:
        text = text.replace(SPECIAL, b" ")
    if not text:
        return []
    if b"  " not in text and text[:1] != b" " and text[-1:] != b" ":
        return text.split(b" ")
    return [u[1:] for u in UNIT.findall(b" " + text)]


def frequent_units(docs: DataFrame, text: str = "text", table_size: int = 1 << 15, report: int = 1 << 13) -> list[bytes]:
    """About the `table_size` most frequent pre-tokens, counted over every text.

    Each task counts all of its pre-tokens, forgets the rarest whenever it holds 32 * `report` of them, and hands on its
    `report` most frequent in one packed row; rows are merged in a tree of tasks under the same bound. What is sent grows
    with the number of tasks, never with the number of pre-tokens. The choice only affects speed: counts stay exact.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for t in as_bytes(batch.column(0)):
                held.update(units(t))
                if len(held) > 32 * report:
                    held = Counter(dict(held.most_common(4 * report)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held.most_common(report))], pa.binary())], names=["packed"])

    def merge(a: list, b: list) -> list:
        both = Counter(dict(a))
        for k, v in b:
            both[k] += v
        return both.most_common(table_size)

    packed = docs.select(F.col(text)).mapInArrow(count, "packed binary")
    merged = packed.rdd.map(lambda row: pickle.loads(row[0])).treeAggregate([], merge, merge, depth=3)
    return [w for w, _ in merged if len(w) <= 64]


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", count: str = "n_tokens", table_size: int = 1 << 15, cache_size: int = 250_000) -> DataFrame:
    """Add `count`, the number of tokens of each whole text under the SentencePiece model at `model_path`.

    Null and empty texts have 0 tokens. A text of any length is counted whole. All other columns pass through, whatever
    their names; `count` replaces a column of that name. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    model = load_model(model_path)
    if bad := crossing_pieces(model):
        raise ValueError(f"pieces of this model cross spaces: {bad[:3]}")
    encode = counter(model)
    words = [w for w in frequent_units(docs, text, table_size) if b"\n" not in w]
    lengths = list(encode(words))
    shared = spark.sparkContext.broadcast((b"\n".join(words), array("H", (min(n, 65535) for n in lengths)).tobytes()))
    rest = [c for c in docs.columns if c != count]
    plain = docs.select(*(F.col(f"`{c}`") for c in rest))
    schema = widened(plain).add(count, "long")
    at, name = rest.index(text), uuid.uuid4().hex

    def made() -> Cache:
        names, known = shared.value
        frequent = dict(zip(names.split(b"\n"), array("H", known), strict=False))
        cache = Cache(counter(load_model(model_path)), cache_size + len(frequent))
        cache.young.update(frequent)
        cache.fixed = frequent
        return cache

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = kept(("tokens", name), made)
        for batch in (part for whole in batches for part in pieces(whole, at, 2 << 20)):
            lists = [units(t) for t in as_bytes(batch.column(at))]
            table = cache.lookup(set(chain.from_iterable(lists)))
            counts = [sum(map(table.__getitem__, u)) for u in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*rest, count])

    return plain.mapInArrow(run, schema)
