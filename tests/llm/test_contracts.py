"""Operators against brute force, the public tokenizer libraries and their own laws; odd rows and tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import bpe, licences, lsh_forest, mixing, quality, queries, sharding, suffix_dedup, token_counts, topk

from . import brute

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s0"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sentences(seed: int, n: int) -> list[str]:
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    return [" ".join(rnd.choice(words) for _ in range(rnd.randint(40, 120))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank and long texts, null ids and sources, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(1, None, None), (2, "", "a"), (3, " \n\t", "a"), (4, "one", None), (5, "x" * 300_000, "b"), (6, "ab " * 50_000, "b"), (7, "Same text under the MIT license.", "c"), (7, "Same text under the MIT license.", "c"), (None, "lost id é😀", "c"), (8, "<|endoftext|> and\n\n\n more", "c")]
    base = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return base.withColumns({c: F.lit(1) for c in ("key", "size", "hash", "id", "start", "component", "spans", "shard", "slot", "kept", "n_chars", "block", "a", "weight")}).withColumn("lang", F.lit(None).cast("string"))


ODD = {
    "licences": lambda d: licences.scan_licences(d),
    "counts": lambda d: token_counts.token_counts(d, queries.vocabulary(queries.VOCABULARY_JSON)),
    "forest": lambda d: lsh_forest.near_duplicates(d, n=2),
    "shards": lambda d: sharding.shard_documents(d),
    "bpe": lambda d: bpe.bpe_encode(d, queries.vocabulary(queries.VOCABULARY_RANKS)),
    "repeats": lambda d: suffix_dedup.remove_repeats(d),
    "mix": lambda d: mixing.mix_sources(d),
}


@pytest.mark.parametrize("name", ODD)
def test_odd_rows_are_all_answered(odd, name):
    out = ODD[name](odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd.collect())


@pytest.mark.parametrize("name", ODD)
def test_empty_tables_give_empty_ones(odd, name):
    assert ODD[name](odd.where("false")).collect() == []


def test_licence_places(spark):
    texts = ["Under the MIT License. Apache License, Version 2.0! CC BY-NC 4.0 under-the_mit license", None, "cc by cc by nc nc", "UNDER THE mit licensé", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause WITH x */", "é cc\x00by\x7fnc"]
    out = {r.doc_id: r for r in licences.scan_licences(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = [m for m in out[i].matches if m.kind == "base"]
        got = out[i].n_words, len(base), min((m.word for m in base), default=None), max((m.word for m in base), default=None), ",".join(sorted({m.label for m in base}))
        assert got == brute.licence_row(t)
    assert [(e.licences, e.permitted) for e in out[4].expressions] == [("apache-2.0,bsd-3-clause,mit", True)]
    assert 0.0 == out[1].score < out[0].score < 1


def test_licence_query_on_the_table(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op1_license_scan(spark, SF).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licence_row(rows[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


@pytest.mark.parametrize("text, allowed, value", [("mit or gpl-3.0", {"mit"}, True), ("mit and gpl-3.0", {"mit"}, False), ("gpl-3.0 or mit and isc", {"mit", "isc"}, True), ("(gpl-3.0 or mit) and isc", {"mit"}, False), ("gpl-2.0 with classpath and mit", {"gpl-2.0", "mit"}, True)])
def test_licence_expressions(text, allowed, value):
    assert licences.evaluate(licences.parse_expression(text), frozenset(allowed)) is value


@pytest.mark.parametrize("text", ["", "and mit", "(", ")", "or"])
def test_no_licence_expression(text):
    assert licences.parse_expression(text) is None


PIECES = ["a", "b", "the ", "  ", "\n", "\n\n", " ", "'s", "'re", "'", "n't", "1", "23", "!!", "***", "é", "ñ", "日本", "😀", "\xa0", "\x85", "\x1c", "<|endoftext|>", "<|endo", "text", "er", "tion", " un", "\t", "ll", "'l"]


def test_tokens_and_prefix_counts_are_the_libraries():
    import public_tokenizers as public
    import tiktoken
    from tokenizers import Tokenizer

    ranks, whole = public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_50k.json")
    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})
    tokenizer, rnd = Tokenizer.from_file(whole), random.Random(5)
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    for _ in range(150):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 25)))
        packed = bpe.encode_text(text, ranks)
        assert np.frombuffer(packed, "<u4").tolist() == encoding.encode_ordinary(text)
        assert "".join(bpe.decode_ids(packed, ranks, 3)) == text
        prefixes = token_counts.Prefixes(text, whole)
        assert [prefixes.count(n) for n in range(len(text) + 1)] == [count(text[:n]) for n in range(len(text) + 1)]
        budget = rnd.randint(0, 12)
        assert prefixes.longest(budget) == max(n for n in range(len(text) + 1) if count(text[:n]) <= budget)


def test_token_queries_on_the_table(spark):
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary(queries.VOCABULARY_JSON))
    encoding = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(queries.vocabulary(queries.VOCABULARY_RANKS)), special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op2_token_counts(spark, SF).collect():
        n = len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
        assert len(tokenizer.encode(texts[r.doc_id][: r.prefix_chars], add_special_tokens=False).ids) <= 512
    for r in queries.op5_bpe_transducer(spark, SF).collect():
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_utf8_stream_takes_any_cut():
    raw = "aé日😀z".encode() + b"\xff\xc3"
    for cut in range(1, 5):
        stream = bpe.Utf8Stream()
        assert "".join(stream.feed(raw[i : i + cut]) for i in range(0, len(raw), cut)) + stream.close() == raw.decode("utf-8", "replace")


def test_near_duplicates_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute.near_rows(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_minhash_forest(spark, SF).collect()}
    assert got == want


def test_near_duplicates_of_large_groups_and_chains(spark):
    rnd, texts = random.Random(3), sentences(1, 30)
    for base in texts[:3]:
        for _ in range(60):
            words = base.split()
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    chain = sentences(2, 1)[0].split()
    for k in range(10):  # each like the next, the ends unlike
        texts.append(" ".join([f"w{k}{i}" if i % 10 == k else w for i, w in enumerate(chain)]))
    texts += ["", None, "one", "one", "two words", "Two  WORDS"]
    want = brute.near_rows(list(enumerate(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in lsh_forest.near_duplicates(docs_of(spark, texts), n=2).collect()}
    assert got == want


def test_shards_are_balanced_and_slots_gapless(spark):
    texts = {(r.doc_id): r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op4_lpt_shards(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    loads, slots, of = Counter(), defaultdict(list), {}
    for r in rows:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode()), "bytes", None)
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert of.setdefault(texts[r.doc_id], r.shard) == r.shard
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) - min(loads.values()) <= max(r.size for r in rows)


def test_two_level_schedule_is_near_the_plain_one(spark):
    rnd = random.Random(9)
    sizes = [rnd.randint(1, 1000) ** 2 for _ in range(3000)]
    groups = spark.createDataFrame(list(enumerate(sizes)), "key long, weight long")
    loads = Counter()
    for r in sharding.group_shards(groups, 16, len(sizes), chunk_groups=200).join(groups, "key").collect():
        loads[r.shard] += r.weight
    plain = Counter()
    for size, shard in zip(sorted(sizes, reverse=True), sharding.schedule(sorted(sizes, reverse=True), 16)):
        plain[shard] += size
    assert max(loads.values()) <= 1.01 * max(plain.values())


def test_repeats_on_the_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = dict(zip((r.doc_id for r in rows), brute.repeat_rows([r.text for r in rows])))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op6_suffix_dedup(spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("ranges", [1, 40])
def test_repeats_across_and_within_ranges(spark, monkeypatch, ranges):
    """A passage in most texts, texts that repeat themselves, short periods, strings just long enough, and tokens that lie across boundaries."""
    rnd, base = random.Random(4), sentences(7, 60)
    passage = sentences(8, 1)[0][:260]
    texts = [t[: (cut := rnd.randrange(len(t)))] + passage[: rnd.randint(180, 260)] + t[cut:] for t in base]
    texts += ["a" * 1000, "ab" * 300, base[0] + base[0], passage[:199], passage[:200], passage[:201], "é" * 150, None, "", "z" * 200, base[5], base[5]]
    if ranges > 1:
        monkeypatch.setattr(suffix_dedup, "RANGE_RUNS", 10)
        monkeypatch.setattr(suffix_dedup, "TOKEN_RUNS", 20)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute.repeat_rows(texts)


def test_top_k_is_exact_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=40)]) for i in range(400)]
    rows += [(i, rows[i - 400][1]) for i in range(400, 450)] + [(500, None), (600, [None] * 40), (700, [float("nan")] * 40), (None, rows[0][1]), (801, [float("inf")] + [0.0] * 39), (900, [1.0, 2.0]), (901, [3.0, 4.0]), (1000, []), (1100, [2.0**21] * 40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1))
    ints = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in ints:
        if q % 100 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q])))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:10])]
    got = [tuple(r) for r in topk.exact_top_k(table, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == sorted(want)


def test_mix_meets_its_targets_and_bounds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sources = {r.doc_id: r.source for r in docs.collect()}
    first, again = (sorted(map(tuple, mixing.mix_sources(d).collect())) for d in (docs, docs.repartition(7)))
    assert first == again
    taken, size, target = Counter(), Counter(), {}
    for doc_id, n, source_size, aim, took in first:
        assert 0 <= took <= 2 * n
        s = sources[doc_id]
        taken[s] += took
        size[s] += n
        target[s] = aim
        assert source_size > 0
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    order = sorted(size)
    assert target == dict(zip(order, mixing.targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    words = Counter()
    for r in mixing.mixed_documents(docs).collect():
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({d: t for d, *_, t in first if t})


def test_targets_share_again_what_is_above():
    assert mixing.targets([100, 100, 1000], [5, 2, 1]) == [200, 200, 1400]
    assert mixing.targets([0, 10], [5, 2]) == [0, 15]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100, 1000])
def test_permutation_holds_every_index(size):
    assert sorted(mixing.permuted(np.arange(size), size, 3).tolist()) == list(range(size))


def test_draws_take_what_is_owed():
    out = mixing.draws([10, 0, 1000, 3], 7, 1)
    assert out.sum(0).tolist() == [10, 0, 1000, 3] and out.sum(1).max() - out.sum(1).min() <= 1


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in quality.resample(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    insults = ("stupid", "idiot", "moron", "worthless", "trash", "disgusting", "loser", "clown")
    clean = [r.doc_id in kept for r in held if r.quality == 1 and not r.toxic]
    low = [r.doc_id in kept for r in held if r.quality == 0]
    toxic = [r.doc_id in kept for r in held if r.toxic and any(x in r.text.lower() for x in insults)]
    assert np.mean(clean) > 0.95 and np.mean(low) < 0.05 and np.mean(toxic) < 0.1


def test_sample_of_a_given_size_is_the_largest_keys(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    every = quality.resample(docs, labels, size=10**9)
    keys = sorted((r.gumbel_key for r in every.collect()), reverse=True)
    some = quality.resample(docs, labels, size=100).collect()
    assert len(keys) == docs.count() and len(some) >= 100 and min(r.gumbel_key for r in some) == pytest.approx(keys[99])
