"""N-gram Jaccard join by multiple-global-order filtering, down to connected groups.

A text's set is its distinct word shingles. If two sets of sizes x and y reach the Jaccard threshold t, they share at least
t * max(x, y) shingles; so under any one global order of all shingles, the first x - ceil(t * x) + 1 of one set and the first
y - ceil(t * y) + 1 of the other have one in common. That holds for every order, so a linked pair must share prefix shingles
under each of several different orders at once. The first order puts shingles of fewer sets first, by exact counts over all
texts; the others are orders by hashes that have nothing to do with each other or with counts, so what shares a rare shingle
by chance and little else is parted by them. A shingle of one set only can be shared by none and is not sent on.

Pairs are never listed. Under the first order, sets with a prefix shingle in common are joined into blocks (to the smallest
set of the shingle's list, so a list of a million sets costs a million rows); each further order splits every block the
same way by its own prefixes, and sets left alone drop out. What remains is verified block by block with matrix products
over exact sets; a block of over `tile` sets is cut into tiles, and every two tiles meet in a task of their own, so no task
grows with a group. Copies of a set are one set throughout. Links found become groups by label propagation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, discard, pieces, settle, small_side, spread_join
from .packed_counts import ASK, FAN, FIRST, MIX, asked, asks, chunked, counts_unpacked, exchange, mixed, word_hashes


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes, all in a row, and where each text's begin, with the end.

    Fewer words than `words` are one shingle, none give the empty set.
    """
    h, n = word_hashes(texts)
    first = np.concatenate([[0], np.cumsum(n)])
    size = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    own = np.repeat(np.arange(len(texts)), size)
    at = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(words):
            inside = at + i < first[own + 1]
            word = h[np.minimum(at + i, len(h) - 1)] if len(h) else h
            out = np.where(inside, mixed(out + word, MIX[1]), out)
    cuts = np.concatenate([[0], np.cumsum(size)])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (own[1:] != own[:-1])
    return out[new], np.concatenate([[0], np.cumsum(np.bincount(own[new], minlength=len(texts)))]).astype(int)


def class_of(s: np.ndarray) -> tuple[int, int]:
    """Two numbers for a set, equal for equal sets. The first names it, the second proves that no other set has that name."""
    data = s.tobytes()
    return xxhash.xxh3_64_intdigest(data) - (1 << 63), xxhash.xxh64_intdigest(data, 1) - (1 << 63)


def classes(sets: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int] | None]:
    return [class_of(sets[a:b]) if b > a else None for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (n * percent + 99) // 100 + 1


def distinct_sets(table: pa.Table, words: int) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
    """Sets and cuts of a chunk's texts, their classes, and which shingles belong to the first text of their class."""
    sets, cuts = shingle_sets(as_bytes(table.column("text")), words)
    names = classes(sets, cuts)
    seen: set = set()
    new = np.array([c is not None and c not in seen and not seen.add(c) for c in names], bool)
    return sets, cuts, names, np.repeat(new, np.diff(cuts))


def requests(words: int, bits: int, many: int):
    def run(table: pa.Table) -> pa.Table:
        sets, _, _, new = distinct_sets(table, words)
        keys, n = np.unique(sets[new] >> np.uint64(64 - bits), return_counts=True)
        return asks(asked(table.column("chunk")[0].as_py(), 1, FIRST, keys, n, None, bits, many))

    return run


def in_order(s: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Places of shingles in the `k`-th global order, given the number of sets of each: by that, or by a hash alone."""
    return np.lexsort((mixed(s, MIX[0]), n)) if k == 0 else np.argsort(mixed(s, MIX[k]), kind="stable")


def prefixes(words: int, bits: int, percent: int, orders: int):
    """Per text: key, row, set size, class and its proof, and by order the prefix shingles that other sets may have."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())))

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        columns: list = [[], [], [], []]
        if table.num_rows:
            sets, cuts, names, new = distinct_sets(table, words)
            short = sets >> np.uint64(64 - bits)
            keys = np.unique(short[new])
            given = sorted(answers.select(["range", "a"]).to_pylist(), key=lambda r: r["range"])
            counts = np.concatenate([np.empty(0, np.int64), *(counts_unpacked(r["a"]) for r in given)])
            if len(counts) != len(keys):
                raise RuntimeError("the answers do not fit the chunk")
            df = counts[np.searchsorted(keys, short)]
            size = np.diff(cuts)
            unshared = np.add.reduceat(np.append(df == 1, False).astype(np.int64), cuts[:-1]) * (size > 0)
            most = prefix_size(size, percent)
            out: list = []
            for i, (a, b, m) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), most.tolist(), strict=True)):
                if a == b or unshared[i] >= m:  # the rarest come first, so the first order's prefix has no shared shingle
                    out.append([[]] * orders)
                    continue
                s, n = sets[a:b], df[a:b]
                own = (in_order(s, n, k)[:m] for k in range(orders))
                out.append([s[x[n[x] > 1]].view(np.int64) for x in own])
            columns = [size, [c and c[0] for c in names], [c and c[1] for c in names], out]
        names_of = ("n", "class", "proof", "prefixes")
        return pa.table({"key": table.column("key"), "row": table.column("_row")} | {x: pa.array(c, t) for x, c, t in zip(names_of, columns, types, strict=True)})

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, label: every node of `edges` (a, b) with the smallest node that it can reach.

    Rounds of taking the neighbours' smallest label and then that label's own label; sums and minima are partial before
    each exchange, nodes of many edges are spread, and every round is written to the shared folder.
    """
    both = settle(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"), "degree"))
    while True:
        seen = spread_join(both, labels.withColumnRenamed("node", "b"), ["b"], "degree").groupBy("a").agg(F.min("label").alias("m"))
        least = labels.join(seen, labels["node"] == seen["a"]).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"), "degree")
        # a label that leads on is itself a node with a smaller label; the labels of most nodes do not
        hop = small_side(settle(labels.where("label != node").select(F.col("node").alias("label"), F.col("label").alias("next"))))
        out = settle(least.join(hop, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "was", "degree"))
        changed = not out.where("label != was").isEmpty()
        discard(labels)
        labels = out.drop("was")
        if not changed:
            discard(both)
            return labels.select("node", "label")


def blocks(prefixes: DataFrame) -> DataFrame:
    """class, block: refine `prefixes` (class, block, token): sets of a block that share tokens, directly or through others,
    stay together. Sets that share none are left out."""
    lists = prefixes.groupBy("block", "token").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("weight")).where("low < high")
    lists = settle(lists.select("block", "token", "low", "weight"))
    edges = spread_join(prefixes, lists, ["block", "token"], "weight").where("class != low").select(F.col("class").alias("a"), F.col("low").alias("b"))
    return components(edges).select(F.col("node").alias("class"), F.col("label").alias("block"))


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the smallest place that verified links lead to. Exact, by products of 0/1 matrices, a few columns at a time."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    held, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes)
    shared = n[column] > 1
    row, column = row[shared], (np.cumsum(n > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((m, m), np.float32)  # integers below 2**24 are exact
    wide, width = int(column[-1]) + 1 if len(column) else 0, 2048
    cuts = np.searchsorted(column, np.arange(0, wide + width, width))
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = np.zeros((m, width), np.float32)
        part[row[a:b], column[a:b] - i * width] = 1
        both += part @ part.T
    link = 100 * both.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :] - both.astype(np.int64))
    label = np.arange(m)
    while True:
        new = np.minimum(label, np.where(link, label[None, :], m).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verified(candidates: DataFrame, sizes: DataFrame, total: int, percent: int, tile: int) -> DataFrame:
    """a, b: links that join the sets of each block of `candidates` (class, block, set) as all of its links do.

    `sizes` has the number of sets of each block as `m`, `total` is the number of shingles of all of them.
    """
    spread = max(1, total * 8 // (8 << 20))
    # small blocks share a task's group, large ones are dealt into tiles that meet two by two
    known = spread_join(candidates, sizes, ["block"], "m").withColumn("tiles", F.ceil(F.col("m") / F.lit(tile)).cast("int"))
    mine = F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int")
    alone = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("block"), F.lit(spread))).otherwise(F.col("block"))
    met = known.withColumn("unit", alone).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("unit", (F.col("tiles") > 1).alias("large"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "block", "class", "set")

    def check(group: pa.Table) -> pa.Table:
        block, cls = group.column("block").to_numpy(), group.column("class").to_numpy()
        sets = group.column("set").to_pylist()
        order = np.lexsort((cls, block))
        cuts = np.flatnonzero(np.diff(block[order], prepend=block[order[0]] - 1 if len(order) else 0)) if len(order) else []
        a, b = [], []
        for start, end in zip(cuts, [*cuts[1:], len(order)]):
            own = order[start:end]
            if len(own) > 1:
                label = linked([np.frombuffer(sets[i], "<u8") for i in own], percent)
                moved = np.flatnonzero(label != np.arange(len(own)))
                a.append(cls[own[moved]])
                b.append(cls[own[label[moved]]])
        none = np.empty(0, np.int64)
        return pa.table({"a": np.concatenate(a) if a else none, "b": np.concatenate(b) if b else none})

    return met.groupBy("unit", "large", "i", "j").applyInArrow(check, "a long, b long")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, orders: int = 3, tile: int = 768, chunk_bytes: int = 8 << 20, fan: int = FAN) -> DataFrame:
    """Per row: key, n_shingles (its set's size) and component_id, the smallest key reachable by links, its own included.

    Two rows link if the Jaccard similarity of their sets is at least `percent` / 100, computed in integers. Words are
    split at ASCII white space, A-Z lower-cased; fewer words than a shingle make one shingle of all of them. Null, empty
    and wordless texts have no shingles and link with nothing. Rows of equal sets link, also where keys repeat; a null key
    is no smallest key, and a group of null keys alone has a null component_id. Other columns are left out, whatever their
    names; an empty table gives no rows. Shingles are told apart by 64-bit hashes.
    """
    if not 1 <= orders <= 4:
        raise ValueError("one to four orders")
    many, plain = chunked(docs, text, chunk_bytes, F.col(key).alias("key"), F.col(text).alias("text"))
    # keys short enough to pack well and long enough that few shingles share one; they only order, sets stay exact
    bits, parts = min(56, (many * chunk_bytes // 4).bit_length() + 6), min(many, fan)
    kind = docs.schema[key].dataType.simpleString()
    requested = plain.select("chunk", "text").groupBy("chunk").applyInArrow(requests(words, bits, parts), ASK)
    answers = exchange(requested, {1: bits}, many, parts, fan=fan)
    both = plain.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    rows = settle(both.applyInArrow(prefixes(words, bits, percent, orders), f"key {kind}, row long, n long, class long, proof long, prefixes array<array<long>>"))

    # one row per distinct set, with a text that has it; all rows of a class have the same set
    clash = F.raise_error(F.lit("two sets share a class")).cast("long")
    reps = rows.where("class is not null").groupBy("class").agg(F.min("key").alias("key"), F.min("row").alias("row"), F.min("n").alias("n"), F.count("*").alias("copies"), F.min("proof").alias("low"), F.max("proof").alias("high"))
    reps = settle(reps.select("class", "key", "row", "n", F.when(F.col("low") == F.col("high"), F.col("copies")).otherwise(clash).alias("copies")))
    sets = rows.where("class is not null and size(prefixes[0]) > 0").select("class", "prefixes").dropDuplicates(["class"])
    for k in range(orders):
        tokens = sets.select("class", F.explode(F.col("prefixes")[k]).alias("token"))
        block = blocks(tokens.withColumn("block", F.lit(0).cast("long")) if k == 0 else tokens.join(small_side(block), "class"))
    sizes = settle(block.groupBy("block").agg(F.count("*").alias("m")))

    # the sets that are left, read from one text each
    chosen = settle(reps.join(small_side(block), "class").select("row", "n"))
    total = chosen.agg(F.sum("n")).first()[0] or 0
    texts = plain.join(small_side(chosen.select(F.col("row").alias("_row"))), "_row", "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 0):
                flat, cuts = shingle_sets(as_bytes(part.column(0)), words)
                own = [(c[0], flat[a:b].tobytes()) for c, a, b in zip(classes(flat, cuts), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if c is not None]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in own], pa.int64()), pa.array([x for _, x in own], pa.binary())], names=["class", "set"])

    found = texts.select("text").mapInArrow(read, "class long, set binary").join(small_side(block), "class").dropDuplicates(["class"])
    label = settle(components(verified(found, sizes, total, percent, tile)).select(F.col("node").alias("class"), "label"))

    # groups of linked classes; every other class is a group of its own
    linked_keys = label.join(reps.select("class", "key"), "class")
    least = settle(linked_keys.groupBy("label").agg(F.min("key").alias("least"), F.count("*").alias("weight")))
    member = settle(spread_join(label, least, ["label"], "weight").select("class", "least", F.lit(True).alias("grouped")))
    owner = reps.join(small_side(member), "class", "left").select("class", F.when(F.col("grouped"), F.col("least")).otherwise(F.col("key")).alias("component_id"), "copies")
    out = spread_join(rows.select("key", "n", "class"), settle(owner), ["class"], "copies", "left")
    own = F.when(F.col("class").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))
