"""License scan: an exact set-similarity join between text blocks and license templates.

A block is a sentence of a text, over as many lines as it is wrapped, a template the word set of a license sentence. A
template is found in a block if at least `threshold` of its words are there. Words are put in one global order, rarest first by their count in the whole
corpus; words that no template has come before all others and can never match. Then, for a template T, a block B and the
least overlap a = ceil(threshold * |T|): one of the first |T| - a + 1 words of T is among the first |B| - a + 1 of B
(prefix filter), |B| >= a (length filter), and at the first common word at places i and j, 1 + min(|T| - i - 1, |B| - j - 1)
>= a (positional filter). What passes is verified by counting. No pair is lost.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes

#: Bytes that are no part of a word become spaces, A-Z become a-z.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
#: Sentence ends and blank lines. A single line break is white space, and templates have colons and semicolons inside.
BLOCK_END = re.compile(rb"[.!?]\s+|(?>\r\n?|\n)[^\S\r\n]*(?>\r\n?|\n)\s*")

#: Fixed phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Fixed sentences of well-known public licenses and their labels.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("all rights reserved", "reserved"),
]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]  # rarest first
    least: int  # overlap needed

    @property
    def prefix(self) -> tuple[bytes, ...]:
        return self.words[: len(self.words) - self.least + 1]


def global_counts(docs: DataFrame, vocabulary: set[bytes], text: str) -> dict[bytes, int]:
    """How often each of the templates' words occurs in all texts. At most a row per word and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for t in as_bytes(batch.column(0)):
                held.update([w for w in words_of(t) if w in vocabulary])
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text)).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in rows.collect()}  # no more rows than the templates have words


def ordered(templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float) -> tuple[list[Template], dict[bytes, tuple[int, bytes]]]:
    sets = [(label, set(words_of(words.encode()))) for words, label in templates]
    rank = {w: (counts.get(w, 0), w) for _, s in sets for w in s}
    return [Template(label, tuple(sorted(s, key=rank.__getitem__)), ceil(threshold * len(s) - 1e-9)) for label, s in sets if s], rank


class Matcher:
    """The templates' side of the join, indexed by the words of their prefixes."""

    def __init__(self, templates: list[Template], rank: dict[bytes, tuple[int, bytes]]):
        self.rank = rank
        self.index: dict[bytes, list[tuple[Template, int]]] = {}
        for t in templates:
            for i, w in enumerate(t.prefix):
                self.index.setdefault(w, []).append((t, i))
        self.keys = set(self.index)
        self.shortest = min((t.least for t in templates), default=0)

    def block(self, words: set[bytes]) -> list[tuple[Template, float]]:
        """Templates found in a block, with the share of their words."""
        if len(words) < self.shortest or self.keys.isdisjoint(words):
            return []
        known = sorted((w for w in words if w in self.rank), key=self.rank.__getitem__)
        foreign, size, seen, found = len(words) - len(known), len(words), set(), []
        for place, w in enumerate(known, foreign):
            for t, i in self.index.get(w, ()):
                if id(t) in seen:
                    continue
                seen.add(id(t))  # the first common word: those before it in either order are not in the other
                if size < t.least or place > size - t.least or 1 + min(len(t.words) - i - 1, size - place - 1) < t.least:
                    continue
                overlap = sum(x in words for x in t.words)
                if overlap >= t.least:
                    found.append((t, overlap / len(t.words)))
        return found


class Phrases:
    """Places where the words of a phrase stand one after another."""

    def __init__(self, phrases: dict[str, str]):
        self.phrases = [(words_of(p.encode()), label) for p, label in phrases.items()]

    def find(self, words: list[bytes], distinct: set[bytes]) -> list[tuple[int, str]]:
        found = []
        for phrase, label in self.phrases:
            if all(w in distinct for w in phrase):
                at = -1
                while True:
                    try:
                        at = words.index(phrase[0], at + 1)
                    except ValueError:
                        break
                    if words[at : at + len(phrase)] == phrase:
                        found.append((at, label))
        return found


def grouped(templates: list[tuple[str, str]], most_words: int) -> list[list[tuple[str, str]]]:
    """Templates in groups of about `most_words` words each; one group at least."""
    groups, held = [[]], 0
    for t in templates:
        n = len(words_of(t[0].encode()))
        if held and held + n > most_words:
            groups.append([])
            held = 0
        groups[-1].append(t)
        held += n
    return groups


SPAN = pa.struct([("label", pa.string()), ("block", pa.int64()), ("share", pa.float64())])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = 0.8, most_words: int = 100_000) -> DataFrame:
    """Per document: key, n_words, n_base, first_word, last_word, base_labels, labels, score, and `spans`, an array of
    (label, block, share) with each matching block's number in its text.

    `score` is the largest share of a template's or phrase's words found together: 1 for a phrase, 0 if nothing is found.
    A null or empty text has no words, no spans, null places and empty labels. Repeated rows and null keys each give their
    row; other columns are left out, whatever their names; an empty table gives no rows. Templates are given as a parameter,
    so their side is sent with the task, `most_words` words of templates at a time: every further group is one more pass over
    the rows of a task. The documents are never shuffled.
    """
    found_at = T.ArrayType(T.StructType().add("label", "string").add("block", "long").add("share", "double"))
    rows = docs.select(F.col(key), F.col(text).alias("_text"))
    schema = rows.select(F.col(key)).schema
    *firsts, last = grouped(templates, most_words)
    for group in firsts:
        rows = rows.mapInArrow(spans_of(sides(docs, group, text, threshold)), T.StructType([*schema.fields]).add("_text", "string").add("spans", found_at))
    for name in ("n_words", "n_base", "first_word", "last_word"):
        schema = schema.add(name, "long")
    schema = schema.add("base_labels", "string").add("labels", "string").add("score", "double").add("spans", found_at)
    find, types = spans_of(sides(docs, last, text, threshold)), [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Phrases(phrases)
        for batch in find(batches):
            out: list[list] = [[] for _ in types]
            for t, spans in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = words_of(t)
                base = finder.find(words, set(words))
                places, names = [a for a, _ in base], {x for _, x in base}
                row = (len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(names)), ",".join(sorted(names | {s["label"] for s in spans})), max([0.0, *(s["share"] for s in spans), *(1.0 for _ in base[:1])]))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True)), batch.column(2)], names=schema.names)

    return rows.mapInArrow(run, schema)


def sides(docs: DataFrame, templates: list[tuple[str, str]], text: str, threshold: float) -> tuple:
    vocabulary = {w for t, _ in templates for w in words_of(t.encode())}
    return ordered(templates, global_counts(docs, vocabulary, text), threshold)


def spans_of(templates_side: tuple):
    """Batches of key, text and maybe spans, with the spans of these templates added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*templates_side)
        for batch in batches:
            before = batch.column(2).to_pylist() if batch.num_columns > 2 else [[]] * batch.num_rows
            out = []
            for t, known in zip(as_bytes(batch.column(1)), before, strict=True):
                spans = list(known)
                if not matcher.keys.isdisjoint(words_of(t)):
                    for number, block in enumerate(BLOCK_END.split(t)):
                        spans += [{"label": f.label, "block": number, "share": share} for f, share in matcher.block(set(words_of(block)))]
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(SPAN))], names=[batch.schema.names[0], "_text", "spans"])

    return run
