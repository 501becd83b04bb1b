"""Language identification with word-first backoff.

A known word is scored by its log frequency in each language. A word that was never seen is scored by its longest known
character n-grams instead: n-grams of the largest order that the tables know cover it, and only where none of that order
is known does the next shorter order speak. The text's scores are sums over its words; the prediction is the best.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Cache, as_bytes, kept, pieces, widened

UNDETERMINED = "und"
SPLIT = re.compile(r"[\W\d_]+")


def words_of(text: bytes) -> list[str]:
    """Lower-cased runs of letters."""
    return SPLIT.sub(" ", text.decode("utf-8", "replace").lower()).split()


class Model:
    """Tables of log frequencies: words, and character n-grams by order. The sample that they come from bounds their sizes."""

    def __init__(self, langs: list[str], words: dict[str, bytes], grams: list[tuple[int, dict[str, int], np.ndarray]], floor: np.ndarray):
        self.langs, self.words, self.grams, self.floor = langs, words, grams, floor
        self.name = uuid.uuid4().hex

    @classmethod
    def of(cls, counts: dict[str, Counter], orders: tuple[int, ...], smooth: float = 0.5) -> Model:
        """From each language's word counts; `orders` from the longest n-gram to the shortest."""
        langs = sorted(counts)

        def table(by_lang: list[Counter]) -> tuple[dict[str, int], np.ndarray]:
            total = np.array([c.total() for c in by_lang], dtype=float)
            both: Counter = Counter()
            for c in by_lang:
                both.update(c)
            rows = np.array([[c[k] for c in by_lang] for k in both], dtype=float).reshape(len(both), len(langs))
            return {k: i for i, k in enumerate(both)}, np.log((rows + smooth) / (total + smooth * max(1, len(both)))).astype(np.float32)

        places, rows = table([counts[x] for x in langs])
        grams = []
        for n in orders:
            by_lang = []
            for lang in langs:
                c: Counter = Counter()
                for w, k in counts[lang].items():
                    padded = f" {w} "
                    for i in range(len(padded) - n + 1):
                        c[padded[i : i + n]] += k
                by_lang.append(c)
            grams.append((n, *table(by_lang)))
        total = np.array([counts[x].total() for x in langs], dtype=float)
        return cls(langs, {w: rows[i].tobytes() for w, i in places.items()}, grams, np.log(smooth / (total + smooth)).astype(np.float32))

    def unseen(self, word: str) -> bytes:
        """Mean log frequencies of the word's n-grams of the largest order of which any is known."""
        padded = f" {word} "
        for n, places, rows in self.grams:
            known = [i for i in (places.get(padded[k : k + n]) for k in range(len(padded) - n + 1)) if i is not None]
            if known:
                return (rows[known].sum(axis=0) / np.float32(len(known))).tobytes()
        return self.floor.tobytes()

    def predict(self, words: list[str], table: dict[str, bytes]) -> tuple[str, float]:
        """Best language, ties to the first by name, and how clear it is: its share of the probability of one word, the mean
        over the words taken as that word's log frequencies. Long texts are not clearer for their length alone."""
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return UNDETERMINED, 0.0
        sums = np.frombuffer(b"".join(map(table.__getitem__, words)), np.float32).reshape(len(words), -1).sum(axis=0, dtype=np.float64)
        best = int(np.argmax(sums))
        return self.langs[best], float(1 / np.exp((sums - sums[best]) / len(words)).sum())


def fit(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = 1000, most_chars: int = 8_000_000, orders: tuple[int, ...] = (4, 3, 2, 1)) -> Model:
    """Fit on a bounded sample of the labelled rows where `learn` holds: of each language the `docs_per_lang` rows of the
    smallest hash of key and text, as many as hold `most_chars` characters together, and one at least. Rows that repeat key
    and text teach once; rows without a language or text teach nothing; null keys teach. All words and n-grams of the sample
    are learned. The sample bounds the tables, which are broadcast; over 500 languages raise. Every text is predicted whole.
    """
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("h"))
    # rows that repeat key and text have one hash; the number of hashes only sets how many rows are ranked; languages are few
    numbers = {r.lang: max(1, r.n) for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if len(numbers) > 500:
        raise ValueError("over 500 languages do not fit the model's tables")
    if not numbers:
        return Model.of({}, orders)
    # the share of hashes that holds about twice the rows that are wanted, so that no task ranks more than those
    share = {x: (1 << 63) - 1 if n <= 2 * docs_per_lang else (1 << 64) * 2 * docs_per_lang // n - (1 << 63) for x, n in numbers.items()}
    near = F.create_map(*(c for x, h in share.items() for c in (F.lit(x), F.lit(h).cast("long"))))
    ranked = rows.select("lang", "h", F.length("text").alias("n")).where(F.col("h") <= near[F.col("lang")]).distinct()
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "n")))
    cuts: dict[str, int] = {}
    held: Counter = Counter()
    full: set[str] = set()
    for r in ranked.where(F.col("r") <= docs_per_lang).orderBy("lang", "r").collect():
        if r.lang in cuts and held[r.lang] + r.n > most_chars:
            full.add(r.lang)
        if r.lang not in full:
            held[r.lang] += r.n
            cuts[r.lang] = r.h
    counts: dict[str, Counter] = {}
    if cuts:
        limit = F.create_map(*(c for x, h in cuts.items() for c in (F.lit(x), F.lit(h).cast("long"))))
        chosen = rows.where(F.col("h") <= limit[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: dict[str, Counter] = {}
            for batch in batches:
                for name, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                    own.setdefault(name, Counter()).update(words_of(t))
            flat = [(name, w, n) for name, c in own.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

        counted = chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        found = counted.toArrow()  # bounded by the sample's characters
        for name, word, n in zip(*(found.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
            counts.setdefault(name, Counter())[word] = n
    return Model.of(counts, orders)


def identify(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score", cache_size: int = 250_000) -> DataFrame:
    """Add `pred` and `score` (0 to 1) for every whole text.

    A null text, or one without a letter, is `und` with score 0, as is every text if nothing was learned. Ties go to the
    first language by name. Only the text is looked at. All other columns pass through; `pred` and `score` replace columns
    of those names; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in (pred, score)]
    plain = docs.select(*(F.col(f"`{c}`") for c in rest))
    at = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        cache = kept(("language", known.name, cache_size), lambda: Cache(lambda ws: map(known.unseen, ws), cache_size, fixed=known.words))
        for batch in (part for whole in batches for part in pieces(whole, at, 2 << 20)):
            lists = [words_of(t) for t in as_bytes(batch.column(at))]
            table = cache.lookup(set(chain.from_iterable(lists)))
            found = [known.predict(words, table) for words in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*rest, pred, score])

    return plain.mapInArrow(run, widened(plain).add(pred, "string").add(score, "double"))
