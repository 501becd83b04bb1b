"""Operators of the training-data subpackage on small tables: edge cases and brute-force versions."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheetloom.llm import exact_dedup, language_id, license_scan, ngram_join, ngram_lm, packed_counts, packing, queries, sentencepiece_codec, token_counts, topk_search, url_filter
from sheetloom.llm.common import Cache

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "a", "É è 42!", "x" * 60_000, "the cat. " * 9_000, "tab\tand\nnew\r\nline  two  spaces ", "<|endoftext|> <s>▁</s>", "İΣ ﬁ 日本語 ͏é", "same text", "same text", "All rights reserved."]


def docs(spark, texts=ODD, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in zip(ids, texts, strict=True)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


# --- 1: license scan ---------------------------------------------------------------------------------------------------


def test_license_base_and_labels(spark):
    texts = ["CC-BY and cc by; ALL rights, reserved", "the GNU General Public License", None, "accby all rightsreserved", "x. Released under the MIT License! y"]
    rows = license_scan.scan(docs(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows] == [(8, 3, 0, 5, "cc-by,reserved"), (5, 1, 2, 2, "gpl"), (0, 0, None, None, ""), (3, 0, None, None, ""), (7, 0, None, None, "")]
    assert rows[4].labels == "mit" and rows[4].score == 1.0 and rows[2].score == 0.0
    assert set(rows[0].labels.split(",")) >= {"cc-by", "reserved"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=6), min_size=1, max_size=4), st.lists(st.sampled_from("abcdefghxyz"), max_size=14), st.integers(5, 10), st.randoms())
def test_license_filters_lose_nothing(templates, block, tenths, rng):
    share = tenths / 10
    named = [(" ".join(t), str(i)) for i, t in enumerate(templates)]
    counts = {c.encode(): rng.randint(0, 5) for c in "abcdefgh"}
    matcher = license_scan.Matcher(*license_scan.ordered(named, counts, share))
    words = {w.encode() for w in block}
    found = {t.label for t, _ in matcher.block(words)}
    assert found == {str(i) for i, t in enumerate(templates) if len({w.encode() for w in t} & words) >= share * len(set(t)) - 1e-9}


def test_license_edges(odd, none):
    assert license_scan.scan(odd).count() == len(ODD) and license_scan.scan(none).count() == 0


# --- 2: SentencePiece ---------------------------------------------------------------------------------------------------


def test_codec_equals_the_library(spark, odd, none):
    library = token_counts.load_model(PIECES)
    out = sentencepiece_codec.encode(odd.withColumn("ids", F.lit(1)), PIECES)
    back = sentencepiece_codec.decode(out, PIECES)
    for r in back.collect():
        t = ODD[r.doc_id]
        assert r.ids == (None if t is None else library.encode(t))
        assert r.decoded == (None if t is None else t.replace("▁", " "))
    assert sentencepiece_codec.encode(none, PIECES).count() == 0 and sentencepiece_codec.digest(none, PIECES).count() == 0
    assert sentencepiece_codec.digest(odd, PIECES).where("not round_trip").count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab▁c", max_size=60))
def test_streaming_viterbi_is_optimal(text):
    pieces = {p: i for i, p in enumerate(["a", "b", "▁", "ab", "ba", "aab", "▁a", "bb", "abab", "▁▁"])}
    scores = {p: -1.0 - (i * 37 % 11) / 3 for p, i in pieces.items()}
    codec = sentencepiece_codec.Codec(pieces, scores, list(range(100, 356)), kind="unigram")
    best = [0.0] + [-math.inf] * len(text)
    for i in range(1, len(text) + 1):
        for j in range(max(0, i - codec.longest), i):
            s = scores.get(text[j:i], codec.unknown if i - j == 1 else -math.inf)
            best[i] = max(best[i], best[j] + s)
    ids = list(codec.stream(text))
    name = {i: p for p, i in pieces.items()}
    assert "".join(name.get(i, "c" if i == 100 + ord("c") else "?") for i in ids) == text
    assert math.isclose(sum(scores[name[i]] if i in name else codec.unknown for i in ids), best[-1], abs_tol=1e-6)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab▁c", max_size=80))
def test_streaming_bpe_is_merging(text):
    pieces = {p: i for i, p in enumerate(["a", "b", "▁", "ab", "ba", "bb", "aab", "abab", "▁a", "bab"])}
    codec = sentencepiece_codec.Codec(pieces, {p: -float(i) for p, i in pieces.items()}, list(range(100, 356)))
    assert list(codec.stream(text)) == [i for p in codec.merged(text) for i in codec.emit(p)]


def test_window_commits_early():
    codec = sentencepiece_codec.Codec.of(token_counts.load_model(PIECES))
    read = 0

    def chars():
        nonlocal read
        for c in "▁" + "word" * 500:
            read += 1
            yield c

    first = next(codec.stream(chars()))
    assert read <= 4 * codec.longest and first >= 0


# --- 3: language model --------------------------------------------------------------------------------------------------


def test_lm_counts_and_weights(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "A c", "d d"]) for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", "zz a"]
    table = docs(spark, texts)
    train = queries.remainder("doc_id", 7) != 2
    rows = {r.doc_id: r for r in ngram_lm.score(table, train, chunk_bytes=400).collect()}
    words = lambda t: [*(t or "").lower().split(), "</s>"]
    learned = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for i in learned for w in words(texts[i]))
    n, v = c.total(), len(c)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in learned, len(words(t)), sum(c[w] > 0 for w in words(t)), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in words(t)), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score <= 0
    held = [i for i in range(len(texts)) if i not in learned]
    assert sum(rows[i].score for i in held) > sum(rows[i].base_score for i in held)


def test_em_prefers_what_predicts():
    good = ngram_lm.learn([(3, 100, 0.9, 0.01)], 1e-4)
    assert good[3, 0] > 0.9 and math.isclose(good[3].sum(), 1.0) and good[0, 0] == 0.0
    assert math.isclose(ngram_lm.learn([], 0.1)[5].sum(), 1.0)


def test_lm_edges(odd, none):
    assert ngram_lm.score(odd, F.lit(True)).count() == len(ODD) and ngram_lm.score(none, F.lit(True)).count() == 0
    row = ngram_lm.score(odd, F.lit(False)).first()
    assert row.train_tokens == 0 and math.isfinite(row.score)


# --- packed counts ------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \t\n\x0b\x1c\xa0", max_size=20), max_size=8), st.integers(1, 40))
def test_word_hashes_are_of_the_words(texts, most):
    h, n = packed_counts.word_hashes([t.encode() for t in texts], most)
    split = [t.encode().lower().split() for t in texts]
    flat = [w for ws in split for w in ws]
    assert n.tolist() == [len(ws) for ws in split] and len(h) == len(flat)
    assert len(set(zip(h.tolist(), flat, strict=True))) == len(set(flat)) == len(set(h.tolist()))


@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=50))
def test_packed_keys_round_trip(keys):
    keys = np.array(sorted(keys), np.uint64)
    assert (packed_counts.unpacked(packed_counts.packed(keys)) == keys).all()


# --- 4: packing ---------------------------------------------------------------------------------------------------------


def test_pieces_are_the_library_ids(odd, none):
    library = packing.load_tokenizer(WORDS)
    found = collections.defaultdict(list)
    for r in packing.pack(odd, WORDS, with_ids=True).collect():
        found[r.doc_id].append(r)
    numbers = [r.sequence_id for rows in found.values() for r in rows]
    assert len(numbers) == len(set(numbers)) and set(found) == set(range(len(ODD)))
    for i, rows in found.items():
        rows.sort(key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in rows), "<u4").tolist()
        assert ids == [*library.encode(ODD[i] or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in rows:
            assert (r.start, r.offset, r.doc_tokens) == (at, 0, len(ids)) and r.length <= 4096 and r.length & (r.length - 1) == 0
            assert r.ids_crc32 == zlib.crc32(r.ids)
            at += r.length
    assert packing.pack(none, WORDS).count() == 0
    by_bucket = sorted((r.sequence_id, r.length) for rows in found.values() for r in rows)
    assert [n for _, n in by_bucket] == sorted(n for _, n in by_bucket)


# --- 5: url filter ------------------------------------------------------------------------------------------------------


def test_rules_and_parts(spark):
    urls = ["http://A.Example.com/en/71?q#f", "https://x.com/en/1", "https://example.net/de/8x", "ftp://xcom/en/", "no url", None, "://h", "http://com/EN/", "a://b?c://d/e"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id int, url string, html string")
    rows = url_filter.judge(df).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule) for r in rows] == [
        ("a.example.com", "/en/71", "example.com/en/7"), ("x.com", "/en/1", "com/en/"), ("example.net", "/de/8x", "example.net/de/8"), ("xcom", "/en/", None),
        ("", "", None), ("", "", None), ("h", "", None), ("com", "/EN/", None), ("b", "", None),
    ]
    assert [r.verdict for r in rows[:3]] == ["allow", "block", "block"] and rows[4].verdict == "allow"
    assert url_filter.judge(df.limit(0)).count() == 0


def test_propagation_equals_power_iteration(spark):
    rng = random.Random(5)
    hosts = [f"h{i}.org" for i in range(12)]
    pages = []
    for i in range(60):
        links = "".join(f'<a href="{rng.choice(["//", "http://", "HTTPS://"])}{rng.choice(hosts)}/p">' for _ in range(rng.randint(0, 4)))
        pages.append((i, f"http://{rng.choice(hosts)}/{rng.choice(['es', 'en'])}/{i}", links + '<img src="/local">'))
    rules = [("h1.org", "/", "block"), ("h2.org", "/", "allow"), ("h3.org", "/en/", "allow")]
    rows = url_filter.judge(spark.createDataFrame(pages, "page_id int, url string, html string"), rules, rounds=8).collect()
    import re

    edge, good, bad = collections.Counter(), collections.Counter(), collections.Counter()
    for _, url, html in pages:
        h = url.split("/")[2]
        path = "/" + url.split("/", 3)[3]
        for r, p, v in rules:
            if h == r and path.startswith(p):
                (good if v == "allow" else bad)[h] += 1
        for t in re.findall(r'href="(?i:https?:)?//([^/"]+)', html):
            if t != h:
                edge[h, t] += 1

    def walk(seeds, edges):
        total, out = sum(seeds.values()), collections.Counter()
        for (a, _), w in edges.items():
            out[a] += w
        score = {h: m / total for h, m in seeds.items()}
        for _ in range(8):
            new = collections.Counter({h: 0.15 * m / total for h, m in seeds.items()})
            for (a, b), w in edges.items():
                new[b] += 0.85 * score.get(a, 0.0) * w / out[a]
            score = new
        return score

    pages_of = collections.Counter(url.split("/")[2] for _, url, _ in pages)
    good, bad = ({h: n / pages_of[h] for h, n in seeds.items()} for seeds in (good, bad))
    turned = {(b, a): w for (a, b), w in edge.items()}
    even = dict.fromkeys(set(pages_of) | {b for _, b in edge}, 1.0)
    trust, distrust = ({h: s / walk(even, links)[h] for h, s in walk(seeds, links).items()} for seeds, links in ((good, edge), (bad, turned)))
    for r in rows:
        assert math.isclose(r.trust, trust.get(r.host, 0.0), abs_tol=1e-9) and math.isclose(r.distrust, distrust.get(r.host, 0.0), abs_tol=1e-9)
        if r.rule is None:
            assert r.verdict == ("block" if r.distrust > 0.75 * (r.trust + r.distrust + 1) else "allow")


# --- 6: n-gram join -----------------------------------------------------------------------------------------------------


def near_texts(rng, n):
    base = [[rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(rng.randint(0, 40))] for _ in range(n // 8)]
    out = []
    for _ in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            if words:
                words[rng.randrange(len(words))] = rng.choice("abc")
        out.append(" ".join(words) if words else rng.choice([None, "", "\t"]))
    return out


@pytest.mark.parametrize("words,percent,tile", [(3, 90, 768), (2, 60, 4), (5, 80, 3)])
def test_groups_equal_brute_force(spark, words, percent, tile):
    texts = near_texts(random.Random(words), 240)
    rows = {r.doc_id: r for r in ngram_join.groups(docs(spark, texts), words=words, percent=percent, tile=tile, chunk_bytes=2000).collect()}
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for i, r in rows.items():
        assert (r.n_shingles, r.component_id) == (len(sets[i]), find(i))


def test_groups_edges(spark, odd, none):
    assert ngram_join.groups(none).count() == 0
    rows = {r.doc_id: r for r in ngram_join.groups(odd, words=3, percent=90).collect()}
    assert rows[11].component_id == 10 and rows[0].n_shingles == 0 and rows[3].n_shingles == 1
    keyless = docs(spark, ["same words here now", "same words here now", "other"], [None, 7, None])
    assert sorted((r.doc_id is None, r.component_id or -1) for r in ngram_join.groups(keyless, words=3).collect()) == [(False, 7), (True, -1), (True, 7)]


# --- 7: token counts ----------------------------------------------------------------------------------------------------


def test_counts_equal_the_library(odd, none):
    library = token_counts.load_model(PIECES)
    rows = token_counts.count_tokens(odd.withColumn("n_tokens", F.lit("clash")), PIECES, table_size=4).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(library.encode(t or "")) for i, t in enumerate(ODD)}
    assert token_counts.count_tokens(none, PIECES).count() == 0


def test_cache_keeps_its_bound():
    asked = []
    cache = Cache(lambda ws: [asked.append(w) or w * 2 for w in ws], most=3, longest=4)
    for words in ([b"a", b"b"], [b"c", b"d"], [b"a", b"toolong"], [b"b", b"e", b"f", b"g", b"h"]):
        found = cache.lookup(words)
        assert all(found[w] == w * 2 for w in words)
        assert len(cache.young) <= 5 and b"toolong" not in cache.young


# --- 8: top-k -----------------------------------------------------------------------------------------------------------


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=6).round(2)]) for i in range(400)]
    vectors += [(400 + i, vectors[0][1]) for i in range(30)]  # ties
    vectors += [(900, None), (901, [1.0] * 5 + [float("nan")]), (902, [None] * 6), (903, [1.0, 2.0]), (950, []), (None, vectors[0][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    rows = topk_search.search(df, df.where("vec_id % 50 = 0"), block=60, query_bytes=400).collect()
    clean = {i: [math.floor(256 * x) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    found = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.score, r.vec_id))
    for q in (i for i in clean if i % 50 == 0):
        best = sorted((-sum(map(lambda a, b: a * b, clean[q], v)), i) for i, v in clean.items() if i != q and len(v) == len(clean[q]))[:5]
        assert found.get(q, []) == [(-s, i) for s, i in best]
    assert topk_search.search(df.limit(0), df.limit(0)).count() == 0


def test_topk_of_huge_components(spark):
    vectors = {0: [2.0**30, 1.0], 1: [2.0**20, 3.0], 2: [-(2.0**21), 0.5], 3: [1e300, 0.0]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    rows = [tuple(r) for r in topk_search.search(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    v = {i: [min(math.floor(256 * x), 2**63 - 1) for x in c] for i, c in vectors.items()}
    held = lambda x: max(min(x, 2**63 - 1), -(2**63))
    best = sorted((-held(v[0][0] * c[0] + v[0][1] * c[1]), i) for i, c in v.items() if i)
    assert rows == [(0, k, i, -s) for k, (s, i) in enumerate(best, 1)]


# --- 9: exact dedup -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_dedup_equals_brute_force(spark, keep):
    rng = random.Random(2)
    texts = [rng.choice(["a", "b ", "b", "", None, "É"]) for _ in range(200)] + ["a", "a"]
    ids = [*range(200), None, 5]
    rows = exact_dedup.dedup(docs(spark, texts, ids).repartition(13), keep=keep, fan_in=2).collect()
    groups = collections.defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        groups[t or ""].append(i)
    best = {t: (max if keep == "largest" else min)(i for i in own if i is not None) for t, own in groups.items()}
    expected = sorted(repr((i, best[t or ""], len(groups[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest())) for i, t in zip(ids, texts, strict=True))
    assert sorted(repr(tuple(r)) for r in rows) == expected


def test_dedup_edges_and_plan(odd, none):
    assert exact_dedup.dedup(none).count() == 0 and exact_dedup.dedup(odd).where("kept").count() == len(ODD) - 2
    plan = exact_dedup.dedup(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- 10: language ID ----------------------------------------------------------------------------------------------------


def test_language_accuracy_on_held_out_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op10_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(table.select("doc_id", "lang", "n_chars"), "doc_id")
    total, right = rows.where("n_chars > 60").agg(F.count("*"), F.count_if(F.col("lang_pred") == F.col("lang"))).first()
    assert right / total > 0.97


def test_language_edges(spark, odd, none):
    model = language_id.fit(odd, F.lit(True))
    out = {r.doc_id: r for r in language_id.identify(odd.withColumn("score", F.lit("clash")), model).collect()}
    assert model.predict(["½²"], {"½²": model.unseen("½²")})[0] == "und"
    assert [out[i].lang_pred for i in (0, 1, 2, 3)] == ["und", "und", "und", "en"] and out[0].score == 0.0
    assert all(0 <= r.score <= 1 for r in out.values())
    empty = language_id.fit(none, F.lit(True))
    assert {r.lang_pred for r in language_id.identify(odd, empty).collect()} == {"und"}
    assert language_id.identify(none, model).count() == 0


def test_backoff_shortens_its_ngrams():
    counts = {"a": collections.Counter({"abcd": 5}), "b": collections.Counter({"wxyz": 5})}
    model = language_id.Model.of(counts, (4, 3, 2, 1))
    assert model.predict(["abcq"], {"abcq": model.unseen("abcq")})[0] == "a"
    assert model.predict(["qxq"], {"qxq": model.unseen("qxq")})[0] == "b"
    assert model.unseen("qqqq") == model.unseen("qqqq") and np.frombuffer(model.unseen("日"), np.float32).shape == (2,)


# --- pipeline -----------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(9)
    long = [" ".join(rng.choice(["the", "house", "of", "many", "rooms", "was", "built", "near", "water"]) + rng.choice("abcdefgh") for _ in range(80)) for _ in range(6)]
    texts = [*long, long[0], long[0], long[1] + " one more word", None, "", "123 456", "1 2 3"]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    table, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in p.STAGES[:3]:
        table = stage(spark, table, str(tmp_path))
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(sorted(r.doc_id for r in table.select("doc_id").collect()))
    assert kept == [list(range(9)), [1, 2, 3, 4, 5, 7, 8], [1, 2, 3, 4, 5, 7]]
    out = p.run(spark, str(tmp_path))
    assert sorted({r.doc_id for r in out.collect()}) == kept[-1]
    assert [n for n, _ in p.STAGES] == ["language_id", "exact_dedup", "ngram_join", "packing"]
