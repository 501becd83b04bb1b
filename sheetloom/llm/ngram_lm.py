"""Language-model scoring with deleted interpolation of word n-grams.

P(w | u v) = l3 * c(u, v, w) / c(u, v) + l2 * c(v, w) / c(v) + l1 * c(w) / N + l0 / (V + 1) for order 3, and alike for others;
the weights l depend on the bucket of the longest context's count: none, 1, 2-3, 4-7 and so on. They are learned by
expectation-maximisation: part of the training documents is deleted from the counts, and its tokens, seen from the counts of
the rest, say how far each estimate can be trusted. For scoring, the deleted part's counts are put back.

Counts cover all training texts; n-grams are told apart by hashes, of 64 bits for words and 56 for longer ones. Most n-grams
are unique, so they are counted in packed rows: see `packed_counts`. A chunk asks for the totals of its words and n-grams,
and then scores its documents with the answers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, settle
from .packed_counts import ASK, FAN, FIRST, MIX, SUM, asked, asks, chunked, counts_unpacked, exchange, mixed, word_hashes

#: Keys of the end of a text and of the place before its first word.
END, START = np.uint64(0x0E0D), np.uint64(0x57A7)
#: Context-count buckets 0, 1, 2-3, 4-7, ..., the last one open.
BUCKETS = 24
#: Histogram of the EM step, by order: steps per power of ten of a probability, and the number of steps.
CELLS = {1: (8, 128), 2: (8, 128), 3: (3, 48)}
#: Each deleted document is one of this many training documents.
DELETED = 8


def bits_of(order: int) -> dict[int, int]:
    return {size: 64 if size == 1 else 56 for size in range(1, order + 1)}


def chunk_tokens(texts: list[bytes], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of the n-grams that end at each token (words, and an end after each text), by size, and each text's length.

    Before its first word a text has START, however far back.
    """
    words, n = word_hashes(texts)
    ends = np.cumsum(n + 1) - 1
    h = np.empty(len(words) + len(n), np.uint64)
    is_word = np.ones(len(h), bool)
    is_word[ends] = False
    h[is_word] = words
    h[ends] = END
    out, longer = [h], h
    for _ in range(1, order):
        before = np.concatenate([[START], longer[:-1]]).astype(np.uint64)
        before[ends[:-1] + 1] = START
        with np.errstate(over="ignore"):
            longer = mixed(mixed(before, MIX[1]) + h, MIX[2])
        out.append(longer >> np.uint64(8))
    return out, n + 1


def requests(many: int, order: int):
    """What a chunk asks for: by size of n-gram, sorted keys with their counts in the chunk in training texts that are kept
    (`a`) and that are deleted for EM (`b`). Chunks of EM (negative) only ask, and for the counts of the kept ones alone."""

    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        sizes, lengths = chunk_tokens(as_bytes(table.column("text")), order)
        role = np.array(table.column("role").to_pylist(), np.int8)  # 0: not in training, 1: kept, 2: deleted
        token_role = np.repeat(role, lengths)
        out: list[tuple] = []
        for (size, bits), keys in zip(bits_of(order).items(), sizes, strict=True):
            keys, roles = (np.append(keys, np.full(len(role), START)), np.append(token_role, role)) if size == 1 else (keys, token_role)
            unique, place = np.unique(keys, return_inverse=True)
            kept, cut = (np.bincount(place[roles == r], minlength=len(unique)) if chunk >= 0 else np.zeros(len(unique), int) for r in (1, 2))
            out += asked(chunk, size, FIRST if chunk < 0 else SUM, unique, kept, cut, bits, many)
        return asks(out)

    return run


def token_counts(docs: pa.Table, answers: pa.Table, order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For every token of a chunk, by size: the count of the n-gram that ends there and of its context; the texts' lengths.

    Words have no context; the context of a text's first token is START, which occurs once in each text.
    """
    sizes, lengths = chunk_tokens(as_bytes(docs.column("text")), order)
    given = sorted(answers.select(["kind", "range", "a"]).to_pylist(), key=lambda r: (r["kind"], r["range"]))
    first = np.cumsum(lengths) - lengths
    counts: list[np.ndarray] = []
    contexts: list[np.ndarray] = []
    for size, keys in enumerate(sizes, 1):
        totals = np.concatenate([counts_unpacked(r["a"]) for r in given if r["kind"] == size])
        unique, place = np.unique(np.append(keys, START) if size == 1 else keys, return_inverse=True)
        if len(totals) != len(unique):
            raise RuntimeError("the answers do not fit the chunk")
        if size == 1:
            texts, place = totals[place[-1]], place[:-1]
        else:
            context = np.concatenate([counts[-1][-1:], counts[-1][:-1]])
            context[first] = texts
            contexts.append(context)
        counts.append(totals[place])
    return counts, contexts, lengths


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(context > 0, np.log2(np.maximum(context, 1)).astype(int) + 1, 0), BUCKETS - 1)


def estimates(counts: list[np.ndarray], contexts: list[np.ndarray], tokens: int) -> list[np.ndarray]:
    """Maximum-likelihood estimates of each token, from the longest n-gram to the word."""
    longer = [np.where(c > 0, n / np.maximum(c, 1), 0.0) for n, c in zip(counts[1:], contexts, strict=True)]
    return [*longer[::-1], counts[0] / max(tokens, 1)]


def buckets_of(contexts: list[np.ndarray], n: int) -> np.ndarray:
    return bucket_of(contexts[-1]) if contexts else np.zeros(n, int)


def learn(cells: list[tuple], uniform: float, order: int = 2, rounds: int = 60) -> np.ndarray:
    """Weights by bucket, from the longest n-gram's to the uniform part's, from cells (bucket, n, estimates from the longest
    n-gram to the word) by expectation-maximisation.

    A bucket without cells takes the weights that were learned over all cells together. Where the longest context was never
    seen (bucket 0) its estimate has no weight.
    """
    table = np.array(cells, float).reshape(len(cells), order + 2)
    bucket, n = table[:, 0], table[:, 1]
    p = np.column_stack([table[:, 2:], np.full(len(cells), uniform)])

    def em(own: np.ndarray, start: np.ndarray) -> np.ndarray:
        weights = start
        for _ in range(rounds):
            share = weights * p[own]
            share /= share.sum(axis=1, keepdims=True)
            weights = (share * n[own][:, None]).sum(axis=0) / n[own].sum()
            weights = np.maximum(weights, 1e-6) / np.maximum(weights, 1e-6).sum()
        return weights

    start = np.array([*[0.9 / order] * order, 0.1])
    shared = em(np.ones(len(cells), bool), start) if cells else start
    out = np.array([em(bucket == b, shared) if (bucket == b).any() else shared for b in range(BUCKETS)])
    if order > 1:
        out[0] = [0.0, *(out[0, 1:] / out[0, 1:].sum())]
    return out


def score(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", order: int = 2, chunk_bytes: int = 8 << 20, weights: np.ndarray | None = None, fan: int = FAN) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Learns from the rows where `training` holds; n-grams have up to `order` words, 1 to 3. A null or empty text is one end
    token. A row without a key is in training if `training` holds for it. Repeated rows count and are scored each. An empty
    table gives no rows; if nothing is trained on, train_tokens is 0 and the uniform part alone gives probabilities. Other
    columns are left out, whatever their names. `score` is the log10 probability under the model, `base_score` under add-one
    unigrams. `weights` (by bucket, as `learn` gives them) are learned unless given.
    """
    if order not in CELLS:
        raise ValueError("orders 1 to 3 are known")
    spark = docs.sparkSession
    learns = F.coalesce(training, F.lit(False))
    deleted = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(DELETED)) == 0
    role = F.when(~learns, 0).when(deleted, 2).otherwise(1).cast("tinyint").alias("role")
    many, rows = chunked(docs, text, chunk_bytes, F.col(key).alias("key"), F.col(text).alias("text"), role)
    em_rows = rows.where("role = 2").withColumn("chunk", -1 - F.pmod(F.xxhash64("_row", F.lit(3)), F.lit(max(1, -(-many // DELETED)))))
    both = rows if weights is not None else rows.unionByName(em_rows)
    parts = min(many, fan)
    requested = both.select("chunk", "text", "role").groupBy("chunk").applyInArrow(requests(parts, order), ASK)
    answers = settle(exchange(requested, bits_of(order), many, parts, (1, START), fan))
    sums = answers.where("chunk is null").agg(*(F.sum(F.col("sums")[i]) for i in range(3))).first()
    tokens, types, kept_tokens = (int(x or 0) for x in sums)
    uniform = 1.0 / (types + 1)
    steps, cells_each = CELLS[order]

    def histogram(own: pa.Table, found: pa.Table) -> pa.Table:
        out: dict = {"bucket": [], "cell": [], "n": []} | {f"log{i}": [] for i in range(order)}
        if own.num_rows:
            counts, contexts, _ = token_counts(own, found, order)
            ps = estimates(counts, contexts, kept_tokens)
            code = buckets_of(contexts, len(ps[0])).astype(np.int64)
            for p in ps:
                step = np.where(p > 0, np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) * steps), 0, cells_each - 2), cells_each - 1)
                code = code * cells_each + step.astype(np.int64)
            code, place = np.unique(code, return_inverse=True)
            out = {"bucket": code // cells_each**order, "cell": code % cells_each**order, "n": np.bincount(place)} | {f"log{i}": np.bincount(place, np.log(np.maximum(p, 1e-300))) for i, p in enumerate(ps)}
        return pa.table({k: pa.array(v, pa.float64() if k.startswith("log") else pa.int64()) for k, v in out.items()})

    if weights is None:
        logs = [f"log{i}" for i in range(order)]
        em_docs = em_rows.select("chunk", "text").groupBy("chunk").cogroup(answers.where("chunk < 0").groupBy("chunk"))
        cells = em_docs.applyInArrow(histogram, "bucket long, cell long, n long, " + ", ".join(f"{x} double" for x in logs))
        cells = cells.groupBy("bucket", "cell").agg(*(F.sum(x).alias(x) for x in ("n", *logs)))
        found = []  # at most BUCKETS * cells_each ** order cells come to the driver
        for r in cells.collect():
            digits = [r.cell // cells_each ** (order - 1 - i) % cells_each for i in range(order)]
            found.append((r.bucket, r.n, *(0.0 if d == cells_each - 1 else float(np.exp(r[x] / r.n)) for d, x in zip(digits, logs, strict=True))))
        weights = learn(sorted(found), uniform, order)
    shared = spark.sparkContext.broadcast(weights)

    def scored(own: pa.Table, given: pa.Table) -> pa.Table:
        if own.num_rows:
            counts, contexts, lengths = token_counts(own, given, order)
            w = shared.value[buckets_of(contexts, len(counts[0]))]
            total = w[:, -1] * uniform
            for i, p in enumerate(estimates(counts, contexts, tokens)):
                total = total + w[:, i] * p
            first = np.cumsum(lengths) - lengths
            base = np.log10((counts[0] + 1) / (tokens + 1 * (types + 1)))
            sums = [np.add.reduceat(x, first) for x in ((counts[0] > 0).astype(np.int64), base, np.log10(total))]
        else:
            lengths, sums = [], [[], [], []]
        return pa.table({"key": own.column("key"), "held_out": pa.array([r == 0 for r in own.column("role").to_pylist()], pa.bool_()), "n_tokens": pa.array(lengths, pa.int64()), "n_known": pa.array(sums[0], pa.int64()), "train_tokens": pa.array([tokens] * own.num_rows, pa.int64()), "base_score": pa.array(sums[1], pa.float64()), "score": pa.array(sums[2], pa.float64())})

    kind = rows.schema["key"].dataType.simpleString()
    final = rows.drop("_row").groupBy("chunk").cogroup(answers.where("chunk >= 0").groupBy("chunk"))
    out = final.applyInArrow(scored, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", key)
