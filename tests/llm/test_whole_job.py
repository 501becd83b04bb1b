"""Cases in which operators once did less than their whole job."""

import collections
import math
import random
import subprocess
import sys
import time
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sheetloom.llm import common, exact_dedup, language_id, license_scan, ngram_join, ngram_lm, packed_counts, packing, sentencepiece_codec, token_counts, topk_search, url_filter

from .test_llm import DOCS, docs, near_texts

# --- 1: license scan ---------------------------------------------------------------------------------------------------

MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance
with the License."""


def test_wrapped_license_headers_are_found(spark):
    whole = [MIT, BSD, GPL, APACHE]
    ways = [whole, [t.replace("\n", "\r\n") for t in whole], [t.replace("\n", "\n# ") for t in whole], [t.replace(" ", "\n") for t in whole], [" ".join(t.split()) for t in whole]]
    rows = license_scan.scan(docs(spark, [t for way in ways for t in way])).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["mit", "bsd", "gpl", "apache-2.0"] * len(ways)
    assert {r.score for r in rows} == {1.0}


def test_license_sentences_do_not_run_together(spark):
    texts = ["released under\n\nthe mit license", "released under\r\n \t\r\nthe mit license", "released under. the mit license", "released under\nthe mit license"]
    rows = license_scan.scan(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["", "", "", "mit"]


# --- 5: url filter -----------------------------------------------------------------------------------------------------


def test_distrust_reaches_the_end_of_a_chain(spark):
    n = 30  # every host links to the next one, the last is blocked by rule
    pages = [(i, f"http://h{i}.org/", f'<a href="//h{i + 1}.org/">') for i in range(n)] + [(n, f"http://h{n}.org/", "")]
    rows = url_filter.judge(spark.createDataFrame(pages, "page_id int, url string, html string"), [(f"h{n}.org", "/", "block")]).orderBy("page_id").collect()
    exact = [0.85 ** (n - i) / (sum(0.85**k for k in range(n - i + 1)) / (n + 1)) for i in range(n + 1)]
    assert [r.distrust for r in rows] == pytest.approx(exact, rel=1e-6)
    assert [r.verdict for r in rows] == ["block" if d > 0.75 * (d + 1) else "allow" for d in exact] and rows[n - 2].verdict == "block"


@pytest.mark.parametrize("local", [1000])
def test_propagation_is_the_converged_solution(spark, local):
    links = [(i, i + 1) for i in range(14)] + [(14, 3), (5, 0)]
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", 1.0) for a, b in links], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("h0", 1.0), ("h4", 3.0)], "host string, mass double")
    a = np.zeros((15, 15))
    for x, y in links:
        a[y, x] = 1 / sum(p == x for p, _ in links)
    exact = np.linalg.solve(np.eye(15) - 0.85 * a, 0.15 * np.bincount([0, 4], [0.25, 0.75], 15))
    found = {r.host: r.score for r in url_filter.propagate(edges, seeds, local_links=local).collect()}
    assert [found[f"h{i}"] for i in range(15)] == pytest.approx(list(exact), rel=1e-6)


# --- pipeline -----------------------------------------------------------------------------------------------------------


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(["house", "room", "water", "stone"]) + rng.choice("abcdefgh") for _ in range(n))


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=repr)


def test_exact_stage_decides_by_row(spark):
    rows = [(None, "A", "s"), (9, "A", "s"), (None, "unique", "s"), (5, "A", "s"), (5, "B", "s"), (3, "C", "t"), (3, "C", "s"), (3, "C", "s"), (None, "D", "s"), (None, "D", "s")]
    out = corpus_pipeline.exact(spark, spark.createDataFrame([(i, t, "en", x, None) for i, t, x in rows], DOCS), "")
    assert rows_of(out) == sorted([(9, "A", "s"), (None, "unique", "s"), (5, "B", "s"), (3, "C", "s"), (None, "D", "s")], key=repr)


def test_near_stage_decides_by_row(spark):
    a, b, c = prose(1), prose(2), prose(3)
    rows = [(None, a), (9, a + " end"), (None, b), (7, c), (7, c + " end"), (7, "alone"), (4, prose(4)), (4, prose(4)), (None, prose(5)), (None, prose(5) + " end")]
    out = rows_of(corpus_pipeline.near(spark, docs(spark, [t for _, t in rows], [i for i, _ in rows]), ""))
    assert {(i, t) for i, t, _ in out} >= {(9, a + " end"), (None, b), (7, "alone"), (4, prose(4))}
    assert len(out) == 6 and sum(t in (c, c + " end") for _, t, _ in out) == 1 and sum(t.startswith(prose(5)) for _, t, _ in out) == 1


def test_near_stage_with_one_null_id(spark):
    a, b = prose(1), prose(2)
    assert [r[:2] for r in rows_of(corpus_pipeline.near(spark, docs(spark, [a, a + " end", b], [None, 9, 5]), ""))] == [(5, b), (9, a + " end")]
    assert [r[:2] for r in rows_of(corpus_pipeline.near(spark, docs(spark, [a, b, b + " end"], [None, 9, 5]), ""))] == [(5, b + " end"), (None, a)]


def test_language_stage_without_labels(spark):
    texts = ["the house", "Ünï 42", "日本語", None, "", "123 _ !", "²"]
    out = corpus_pipeline.languages(spark, spark.createDataFrame([(i, t, None, "s", None) for i, t in enumerate(texts)], DOCS), "")
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2] and out.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def plain_stages(rows):
    """Brute-force exact dedup and near dedup of (doc_id, text) rows with distinct doc_ids; all with one clear language."""
    best = {}
    for i, t in rows:
        best[t] = max(i, best.get(t, i))
    left = sorted((i, t) for t, i in best.items())
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in left}
    group = {i: i for i, _ in left}
    for _ in left:
        for i, _ in left:
            for j, _ in left:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
    return {i: t for i, t in left if group[i] == i}


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng, texts = random.Random(4), [prose(k) for k in range(8)]
    texts += [rng.choice(texts) for _ in range(8)] + [t + " some more words" for t in texts[:3]] + [prose(0).replace("house", "home", 1)]
    docs(spark, texts + ["123 456", "", None]).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = plain_stages(list(enumerate(texts)))
    library = packing.load_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id for r in out} == set(kept)
    for i, t in kept.items():
        assert sum(r.length for r in out if r.doc_id == i) == len(library.encode(t, add_special_tokens=False).ids) + 1
    docs(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


# --- all: clashing names, repeated rows, null keys ----------------------------------------------------------------------

CLASH = "doc_id long, text string, lang string, chunk int, key string, row int, _row int, ids int, spans int, role int, n int, label int, `class` int, block int, weight int, hit int, kind int"


@pytest.mark.parametrize("apply", [
    lambda d: license_scan.scan(d),
    lambda d: sentencepiece_codec.digest(d, public_tokenizers.path("piece_bpe_32k.model")),
    lambda d: ngram_lm.score(d, F.lit(True)),
    lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")).where("start = 0"),
    lambda d: ngram_join.groups(d),
    lambda d: token_counts.count_tokens(d, public_tokenizers.path("piece_bpe_32k.model")),
    lambda d: exact_dedup.dedup(d),
    lambda d: language_id.identify(d, language_id.fit(d, F.lit(True))),
])
def test_odd_tables(spark, apply):
    rows = [(None, "one two three four five six", "en")] * 3 + [(1, "one two three four five six", None), (1, None, "de"), (None, None, None), (2, "", "")]
    df = spark.createDataFrame([(*r, *[7, "k", *[3] * 12]) for r in rows], CLASH)
    assert sorted(str(r.doc_id) for r in apply(df).select("doc_id").collect()) == sorted(str(r[0]) for r in rows)


# --- methods ------------------------------------------------------------------------------------------------------------


def test_license_texts_of_white_space_are_linear():
    start = time.perf_counter()
    assert len(license_scan.BLOCK_END.split(b"the license" + b" " * 1_000_000 + b"\n" + b" " * 1_000_000 + b"x")) == 1
    assert len(license_scan.BLOCK_END.split(b"license\n" * 200_000)) == 1
    assert time.perf_counter() - start < 1.0


def test_license_templates_in_groups(spark):
    table = docs(spark, [MIT, BSD, GPL + "\n\n" + APACHE, "nothing", None])
    plain, parted = ([tuple(r)[:-1] + (sorted(map(str, r.spans)),) for r in license_scan.scan(table, most_words=n).orderBy("doc_id").collect()] for n in (100_000, 15))
    assert plain == parted and plain[2][6] == "apache-2.0,gpl"


def lm_texts(n=160):
    rng = random.Random(3)
    return [" ".join(rng.choice(["a", "b", "a c", "d d", "e"]) for _ in range(rng.randint(0, 20))) for _ in range(n)]


@pytest.mark.parametrize("order,fan", [(2, 4096), (3, 3)])
def test_lm_scores_follow_the_formula(spark, order, fan):
    """Also where a chunk asks so few ranges that answers come by way of several levels."""
    texts = lm_texts()
    weights = np.array([[*[0.2 + 0.01 * b] * order, 1 - order * (0.2 + 0.01 * b)] for b in range(ngram_lm.BUCKETS)])
    rows = {r.doc_id: r for r in ngram_lm.score(docs(spark, texts), F.col("doc_id") % 5 != 2, order=order, chunk_bytes=300, fan=fan, weights=weights).collect()}
    grams = lambda t, s: [tuple((["<s>"] * (s - 1) + t.split() + ["</s>"])[i : i + s]) for i in range(len(t.split()) + 1)]
    learned = [t for i, t in enumerate(texts) if i % 5 != 2]
    count = [None, *(collections.Counter(g for t in learned for g in grams(t, s)) for s in range(1, order + 1))]
    context = [None, None, *(collections.Counter(g[:-1] for t in learned for g in grams(t, s)) for s in range(2, order + 1))]
    n, v = count[1].total(), len(count[1])
    for i, t in enumerate(texts):
        total = 0.0
        for gs in zip(*(grams(t, s) for s in range(order, 0, -1)), strict=True):
            seen = context[order][gs[0][:-1]]
            w = weights[int(np.log2(seen)) + 1 if seen else 0]
            ps = [count[len(g)][g] / context[len(g)][g[:-1]] if context[len(g)][g[:-1]] else 0.0 for g in gs[:-1]] + [count[1][gs[-1]] / n, 1 / (v + 1)]
            total += math.log10(float(np.dot(w, ps)))
        assert rows[i].score == pytest.approx(total, rel=1e-9) and rows[i].train_tokens == n


def test_lm_weights_are_those_of_the_deleted_part(spark):
    texts, table = lm_texts(), docs(spark, lm_texts())
    given = {r.doc_id: r.score for r in ngram_lm.score(table, F.lit(True), chunk_bytes=500).collect()}
    cut = {r.doc_id for r in table.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(ngram_lm.DELETED)) == 0).collect()}
    pairs = lambda t: list(zip(["<s>", *t.split()], [*t.split(), "</s>"], strict=True))
    count = lambda ts: [collections.Counter(f(p) for t in ts for p in pairs(t)) for f in (lambda p: p, lambda p: p[0], lambda p: p[1])]
    two, ctx, one = count([t for i, t in enumerate(texts) if i not in cut])
    all_two, all_ctx, all_one = count(texts)
    n, total, uniform = one.total(), all_one.total(), 1 / (len(all_one) + 1)
    bucket = lambda c: int(np.log2(c)) + 1 if c else 0
    cells = [(bucket(ctx[p[0]]), 1, two[p] / ctx[p[0]] if ctx[p[0]] else 0.0, one[p[1]] / n) for i in cut for p in pairs(texts[i])]
    weights = ngram_lm.learn(cells, uniform)
    for i, t in enumerate(texts):
        exact = sum(math.log10(float(np.dot(weights[bucket(all_ctx[p[0]])], [all_two[p] / all_ctx[p[0]], all_one[p[1]] / total, uniform]))) for p in pairs(t))
        assert given[i] == pytest.approx(exact, rel=5e-3)


def test_counts_beyond_32_bits():
    counts = np.array([1, 2**40, 0])
    assert packed_counts.counts_unpacked(packed_counts.counts_packed(counts)).tolist() == counts.tolist()


def test_further_orders_remove_candidates(spark):
    """Texts that share one rare passage and little else are candidates of the first order, and few are after the others."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(1000)}" for _ in range(n)]
    texts = [" ".join([*words(90), *[f"rare{i}x{j}" for j in range(6)], *words(90)]) for i in range(20) for _ in range(2)]
    sets, cuts = ngram_join.shingle_sets([t.encode() for t in texts], 1)
    each = [sets[a:b] for a, b in zip(cuts, cuts[1:])]
    df = collections.Counter(x for s in each for x in s.tolist())
    heads = [[set(s[ngram_join.in_order(s, np.array([df[x] for x in s.tolist()]), k)[: ngram_join.prefix_size(len(s), 95)]].tolist()) for s in each] for k in range(3)]
    left = [sum(all(h[i] & h[i + 1] for h in heads[:k]) for i in range(0, len(each), 2)) for k in (1, 2, 3)]
    assert left[0] == 20 and left[1] < 20 and left[2] <= left[1]


def test_groups_over_several_levels(spark):
    texts = near_texts(random.Random(7), 80)
    one, two = (sorted(map(tuple, ngram_join.groups(docs(spark, texts), words=2, percent=60, chunk_bytes=1000, fan=f).collect())) for f in (4096, 3))
    assert one == two


def test_topk_stops_reading_early():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 32))
    values = np.floor(64 * (centres[np.arange(4000) % 20] + 0.2 * rng.normal(size=(4000, 32)))).astype(np.int64)
    best = topk_search.Best(np.arange(20), values[:20], 5)
    for start in range(0, 4000, 500):
        best.add(np.arange(start, start + 500), values[start : start + 500])
    scores = values[:20] @ values.T
    for q in range(20):
        assert best.found[q] == sorted((-int(s), i) for i, s in enumerate(scores[q]) if i != q)[:5]
    assert best.log.entries < 0.5 * best.log.of and best.log.resolved < 0.1 * 20 * 4000


def test_window_is_bounded_and_meets():
    codec = sentencepiece_codec.Codec.of(token_counts.load_model(public_tokenizers.path("piece_bpe_32k.model")))
    rng, library = random.Random(1), token_counts.load_model(public_tokenizers.path("piece_bpe_32k.model"))
    seen = []
    plain = codec.meeting
    codec.meeting = lambda last, first: seen.append(len(last)) or plain(last, first)
    for text in ("".join(rng.choice("abcdeinrst") for _ in range(3000)), "a" * 3000, "=" * 2000, "日本語テキスト" * 300):
        assert list(codec.stream("▁" + text)) == library.encode(text)
    assert seen and max(seen) <= 6 * codec.longest


@pytest.mark.parametrize("threshold,verdict", [(0.2, "block"), (0.9, "allow")])
def test_threshold_decides(spark, threshold, verdict):
    pages = [(0, "http://bad.org/x", ""), (1, "http://near.org/", '<a href="//bad.org/">'), *((i, f"http://far{i}.org/", '<a href="/local">') for i in range(2, 8))]
    rows = url_filter.judge(spark.createDataFrame(pages, "page_id int, url string, html string"), [("bad.org", "/x", "block")], threshold=threshold).orderBy("page_id").collect()
    assert rows[0].verdict == "block" and rows[1].verdict == verdict and {r.verdict for r in rows[2:]} == {"allow"}
    assert all(r.trust == r.distrust == 0 for r in rows[2:])


def test_many_rules_are_looked_up_alike(spark):
    rng = random.Random(6)
    urls = [f"http://{rng.choice(['a.', 'b.', ''])}h{rng.randrange(6)}.{rng.choice(['org', 'com'])}/{rng.choice('xyz')}/{rng.randrange(3)}" for _ in range(80)] + [None, "x"]
    rules = list({(f"h{rng.randrange(6)}.{rng.choice(['org', 'com'])}" if rng.random() < 0.7 else rng.choice(["org", "com"]), f"/{rng.choice('xyz')}"[: rng.randint(1, 2)], rng.choice(["allow", "block"])) for _ in range(30)})
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(url_filter.host_of(F.col("url")).alias("h"), url_filter.path_of(F.col("url")).alias("p"))
    one = [r[0] for r in df.select(url_filter.matched(F.col("h"), F.col("p"), rules)).collect()]
    book = url_filter.RuleBook(rules)
    assert [r and tuple(r) for r in one] == [book(r.h, r.p) for r in df.collect()]


def test_joined_rounds_equal_local_ones(spark):
    links = [(0, i) for i in range(1, 9)] + [(i, i + 1) for i in range(1, 9)] + [(9, 0)]
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", 1.0 + a) for a, b in links], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("h0", 1.0), ("h4", 3.0)], "host string, mass double")
    near, far = ({r.host: r.score for r in url_filter.propagate(edges, seeds, rounds=4, local_links=n, hub_links=3).collect()} for n in (1000, 0))
    assert near == pytest.approx(far)


def plain_language(rows, text, orders=(4, 3, 2, 1)):
    """Prediction and score by the method's definition, from (text, lang) rows."""
    words = {}
    for t, lang in rows:
        words.setdefault(lang, collections.Counter()).update(language_id.words_of(t.encode()))
    langs = sorted(words)
    grams = {n: {x: collections.Counter(g for w, k in words[x].items() for g in [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)] for _ in range(k)) for x in langs} for n in orders}
    log = lambda table, item: [math.log((table[x][item] + 0.5) / (table[x].total() + 0.5 * len(set().union(*table.values())))) for x in langs]
    sums, own = [0.0] * len(langs), language_id.words_of(text.encode())
    for w in own:
        if any(words[x][w] for x in langs):
            found = [log(words, w)]
        else:
            for n in orders:
                found = [log(grams[n], g) for g in [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)] if any(grams[n][x][g] for x in langs)]
                if found:
                    break
            found = found or [[math.log(0.5 / (words[x].total() + 0.5)) for x in langs]]
        sums = [s + sum(f[i] for f in found) / len(found) for i, s in enumerate(sums)]
    best = max(range(len(langs)), key=lambda i: (sums[i], -i))
    return langs[best], 1 / sum(math.exp((s - sums[best]) / len(own)) for s in sums)


def test_language_equals_brute_force(spark):
    taught = [("the house of the king", "en"), ("the garden and the water", "en"), ("das haus und der garten", "de"), ("la maison et le jardin", "fr"), ("el jardín y la casa", "es"), ("rare", "zz")]
    asked = ["the haus", "gardens und water", "jardins", "qxq", "maisons la", "rar", "THE King!"]
    table = spark.createDataFrame([(i, t, x, "s", None) for i, (t, x) in enumerate([*taught, taught[0], *((t, None) for t in asked)])], DOCS)
    model = language_id.fit(table.where("doc_id <> 6"), F.lit(True))
    rows = {r.doc_id: r for r in language_id.identify(table, model).collect()}
    for i, t in enumerate(asked, len(taught) + 1):
        pred, score = plain_language(taught, t)
        assert rows[i].lang_pred == pred and rows[i].score == pytest.approx(score, rel=1e-4)


def test_language_sample_is_bounded_for_repeated_rows(spark):
    same = [(None, "the same old words", "en")] * 50 + [(i, f"das wort{i} ist da", "de") for i in range(50)]
    model = language_id.fit(spark.createDataFrame([(i, t, x, "s", None) for i, t, x in same], DOCS), F.lit(True), docs_per_lang=10)
    assert {"the", "same", "old", "words", "das"} <= set(model.words) and sum(w.startswith("wort") for w in model.words) <= 10


def test_hot_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    rows = spark.createDataFrame([(0, i) for i in range(1500)] + [(1 + i, i) for i in range(20)] + [(None, 5)], "k int, v int")
    side = common.settle(rows.where("k is not null and k <> 7").groupBy("k").agg(F.count("*").alias("n")))
    for how in ("inner", "left"):
        found = common.spread_join(rows, side, ["k"], "n", how, whole=0)
        assert sorted(map(str, found.collect())) == sorted(map(str, rows.join(side, "k", how).collect()))


def test_packing_cache_keeps_its_bytes(spark):
    path, room = public_tokenizers.path("word_bpe_49k.json"), 200_000
    cache, plain = packing.word_encoder(path, 500_000, room), packing.word_encoder(path, 500_000)
    for k, n in enumerate([300, 300, 300, 3000, 300]):  # long words; those of one call may be more than there is room for
        words = [f"{i:x}".rjust(60, "q").encode() for i in range(200 * k, 200 * k + n)]
        found, expected = cache.lookup(words), plain.lookup(words)
        assert all(found[w] == expected[w] for w in words)
        assert all(sum(len(w) + len(ids) for w, ids in x.items()) + 160 * len(x) <= room for x in (cache.young, cache.old))
    table = docs(spark, [prose(k) for k in range(20)] + ["", None])
    few, many = (sorted(map(str, packing.pack(table, path, with_ids=True, cache_bytes=b).drop("sequence_id").collect())) for b in (2000, None))
    assert few == many


def test_a_later_stage_gets_the_memory_of_an_earlier_one(monkeypatch):
    freed = []
    monkeypatch.setattr(common, "release", lambda: freed.append(len(common._kept)))
    monkeypatch.setattr(common, "_kept", {})
    for key in ("language", "language", "packing", "packing"):
        assert common.kept((key,), lambda key=key: [key]) == [key]
    assert freed == [0, 0]  # once for each change, after the old one is gone
    common.forget()
    common.forget()
    assert freed == [0, 0, 0] and not common._kept


def test_freed_memory_goes_back_to_the_system():
    code = """
import re
import numpy as np
from sheetloom.llm import common

def held():
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem): +(\\d+)", f.read()))) / 1024

parts = common.kept(("a",), lambda: [np.ones(8000) for _ in range(2000)])
last = np.ones(8000)  # lies above, so the space of the others is not at the heap's end
before = held()
del parts
common.forget()
print(before - held())
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert float(out.stdout) > 90  # of 122 MB
