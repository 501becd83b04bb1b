"""What the operators share: shared checkpoints, batch access to bytes and bounded caches."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Up to this many rows of a few numbers each are broadcast (some 100 MB at most); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's `spark.checkpoint.dir`. One is made only where that is unset and
    everything runs in one process (tests, a single machine); on a cluster an unset folder raises."""
    context = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return folder
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return own_folder()


@functools.cache
def own_folder() -> str:
    return tempfile.mkdtemp(prefix="checkpoints-")


def settle(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again, which cuts its lineage and gives the planner its true size.

    Everything lies under one folder of the application, which may be removed once its results were read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*settled: DataFrame) -> None:
    """Remove settled tables that no later result reads."""
    for df in settled:
        context = df.sparkSession.sparkContext
        for file in df.inputFiles()[:1]:
            folder = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def located(docs: DataFrame, *columns: Column, name: str = "_row") -> DataFrame:
    """`columns` of each row and `name`, a hash of its place: its file and its number there.

    The hash is the same in every run over the rows, however they are split into tasks and whatever executors are lost, and
    differs between rows that are equal. Rows that do not come straight from files are written first.
    """
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(name)
    try:
        return docs.select(*columns, place)
    except AnalysisException:
        written = settle(docs.select(*columns))
        return written.select("*", place)


def small_side(df: DataFrame) -> DataFrame:
    """Hint a settled table for broadcast if its count allows that."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def spread_join(rows: DataFrame, side: DataFrame, on: list[str], weight: str, how: str = "inner", whole: int = 50_000) -> DataFrame:
    """`rows` joined with `side`, a settled table of distinct `on` with the number of `rows` that have it in `weight`.

    Keys of many rows are broadcast and their rows stay where they are, so no key is hot; the rest meets in a shuffle. A key
    has many rows above the `BROADCAST_ROWS`-th part of all: there are no more such keys than may be broadcast. Up to `whole`
    keys are all broadcast.
    """
    keys, total = side.agg(F.count("*"), F.sum(weight)).first()
    if keys <= whole:
        return rows.join(F.broadcast(side), on, how)
    many = max(1000, total // BROADCAST_ROWS)
    hot, cold = side.where(F.col(weight) > many), side.where(F.col(weight) <= many)
    if hot.isEmpty():
        return rows.join(cold, on, how)
    mark = F.broadcast(hot.select(*on, F.lit(True).alias("_hot")))
    marked = rows.join(mark, on, "left")
    near = marked.where("_hot").drop("_hot").join(F.broadcast(hot), on)
    return near.unionByName(marked.where("_hot is null").drop("_hot").join(cold, on, how))


def widened(df: DataFrame) -> T.StructType:
    """A copy of the schema to add fields to; add() alters the one that `df` holds."""
    return T.StructType(list(df.schema.fields))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, text: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of about `most` bytes of text, so that work on one run fits in memory."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


_kept: dict = {}


def kept(key: tuple, make: Callable):
    """What a Python worker keeps from task to task: one thing at a time, so the operators of a pipeline that run in the
    same workers do not add up."""
    if key not in _kept:
        _kept.clear()
        release()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    if _kept:
        _kept.clear()
        release()


def release() -> None:
    """Give memory that is free in this process back to the system, as other processes of the executor need it: the
    allocators would hold on to what earlier stages used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


class Cache:
    """A map from words to results in two generations of at most `most` entries each.

    A full young generation becomes the old one; what is still in use moves back. Words over `longest` bytes are not kept.
    With `room`, for results that are bytes, a generation takes so many bytes at most by `weight`, whatever the words' lengths.
    """

    def __init__(self, encode: Callable[[list[bytes]], Iterable], most: int = 250_000, longest: int = 64, fixed: dict | None = None, room: int | None = None):
        self.encode, self.most, self.longest, self.room = encode, most, longest, room
        self.held = 0
        self.fixed = fixed or {}
        self.young: dict = {}
        self.old: dict = {}

    def lookup(self, words: Iterable) -> dict:
        """A dictionary that holds every one of `words`. Best called with the words of many texts at once."""
        here = self.young
        words = words if isinstance(words, set) else set(words)
        missing = words.difference(here)
        if not missing:
            return here
        found = {}
        for tier in (self.fixed, self.old):
            if tier and missing:
                rest = missing.difference(tier)
                found.update((w, tier[w]) for w in missing.difference(rest))
                missing = rest
        unknown = list(missing)
        found.update(zip(unknown, self.encode(unknown), strict=True))
        kept = found if max(map(len, found)) <= self.longest else {w: r for w, r in found.items() if len(w) <= self.longest}
        size = self.weight(kept)
        if len(here) + len(kept) <= self.most and (self.room is None or self.held + size <= self.room):
            here.update(kept)
            self.held += size
            return here if kept is found else {**{w: here[w] for w in words.difference(found)}, **found}
        out = {**{w: here[w] for w in words.difference(found)}, **found}
        self.old = here
        self.young = out if kept is found else {w: r for w, r in out.items() if len(w) <= self.longest}
        self.held = self.weight(self.young)
        if self.room is not None and self.held > self.room:  # the words of this call alone are too many to stay
            self.young, self.held = {}, 0
        return out

    def weight(self, entries: dict) -> int:
        """About the bytes that entries take: words, results and the objects and places of both. 0 without `room`."""
        return 0 if self.room is None else sum(map(len, entries)) + sum(map(len, entries.values())) + 160 * len(entries)
