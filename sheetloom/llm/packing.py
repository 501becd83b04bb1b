"""Packing by power-of-two decomposition: binary-length pieces, bucketed by equal length.

Each document's ids are cut into pieces of the context length and then into the powers of two of what is left, so that no
sequence crosses documents and every sequence has a power of two as its length: there is no padding at all.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, as_bytes, kept, pieces

#: The table of pieces; `ids` only on request.
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def word_encoder(path: str, cache_size: int, cache_bytes: int | None = None) -> Cache:
    """Ids of white-space separated words as little-endian 32-bit bytes.

    The pre-tokenizer of these vocabularies drops white space and never joins across it, so a text's ids are those of its
    words in a row. It also parts letters from the punctuation behind them. Words of letters alone are one pre-token each,
    which is told by the mark of its last piece, so many of them are encoded in one call.
    """
    library = load_tokenizer(path)
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    if any(any(map(str.isspace, t)) for t in added):
        raise ValueError("an added token holds white space")

    def one(text: str) -> list[int]:
        return library.encode(text, add_special_tokens=False).ids

    if one("a b,") != one("a") + one("b") + one(","):
        raise ValueError("this tokenizer joins across white space or from letters to punctuation")
    last = np.zeros(library.get_vocab_size(), bool)
    last[[i for p, i in library.get_vocab().items() if p.endswith("</w>")]] = True
    signs = {s: np.array(one(s.decode()), "<u4").tobytes() for s in (b".", b",", b";", b":", b"!", b"?")}

    def each(words: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def encode(words: list[bytes]) -> list[bytes]:
        bodies = [w[:-1] if w[-1:] in signs else w for w in words]
        plain = [b for b in set(bodies) if b.isalpha() or letters(b)]
        found: dict[bytes, bytes] = {}
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            ids = np.array(library.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(last[ids]) + 1
            if len(ends) == len(part):  # letters that lower-case to more than letters make more ends
                flat, cuts = ids.tobytes(), (4 * ends).tolist()
                found.update(zip(part, [flat[a:b] for a, b in zip([0, *cuts], cuts)], strict=False))
            else:
                found.update(zip(part, each(part), strict=True))
        rest = [w for w, b in zip(words, bodies, strict=True) if b not in found]
        found.update(zip(rest, each(rest), strict=True))
        return [found[w] if w in found else found[b] + signs[w[-1:]] for w, b in zip(words, bodies, strict=True)]

    return Cache(encode, cache_size, room=cache_bytes)


def letters(word: bytes) -> bool:
    """Whether a word is letters alone, also in the normaliser's form of it."""
    return word.isalpha() or not word.isascii() and unicodedata.normalize("NFC", word.decode()).lower().isalpha()


def words_of(text: bytes) -> list[bytes]:
    """White-space separated words. A-Z are lower-cased as the normaliser would, but where an added token may be meant."""
    return (text if b"<|" in text else text.lower()).split()


def binary_lengths(n: int, context: int) -> list[int]:
    """Lengths of the pieces of `n` ids: whole contexts, then the set bits of the rest from the highest down."""
    rest = n % context
    return [context] * (n // context) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", context: int = 4096, end_id: int = 2, with_ids: bool = False, cache_size: int = 900_000, cache_bytes: int | None = None) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `with_ids` the ids.

    A null or empty text is the end id alone. Every piece is one sequence, at offset 0. The high bits of `sequence_id` are
    the length's bucket, so sorting by it puts equal lengths together; below are the partition and a running number, which
    a task that is run again gives out alike. Nothing is shuffled. Repeated rows and null keys are packed like any others,
    other columns are left out, and an empty table gives no pieces. A worker's cache of words has two generations of at most
    `cache_size` entries and, if given, about `cache_bytes` each; no result depends on them.
    """
    if context & (context - 1):
        raise ValueError("the context length must be a power of two")
    schema = docs.select(F.col(key)).schema
    for field in SCHEMA.split(", "):
        schema = schema.add(*field.split(" "))
    if with_ids:
        schema = schema.add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = kept(("packing", tokenizer_path, cache_size, cache_bytes), lambda: word_encoder(tokenizer_path, cache_size, cache_bytes))
        end = end_id.to_bytes(4, "little")
        part_number, given = TaskContext.get().partitionId(), 0
        for batch in (part for whole in batches for part in pieces(whole, 1, 2 << 20)):
            rows: list[list] = [[] for _ in range(7 + with_ids)]
            lists = [words_of(t) for t in as_bytes(batch.column(1))]
            table = cache.lookup(set(chain.from_iterable(lists)))
            for i, words in enumerate(lists):
                ids = b"".join(map(table.__getitem__, words)) + end
                n, start = len(ids) // 4, 0
                for length in binary_lengths(n, context):
                    own = ids[4 * start : 4 * (start + length)]
                    number = (length.bit_length() << 57) | (part_number << 36) | given
                    for column, value in zip(rows, (i, start, length, zlib.crc32(own), n, number, 0, own), strict=False):
                        column.append(value)
                    start, given = start + length, given + 1
            arrays = [batch.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(c, pa.int64()) for c in rows[1:7])]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(rows[7], pa.binary())] * with_ids if with_ids else arrays, names=schema.names)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
