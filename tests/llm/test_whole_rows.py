"""Operators that give whole rows back: clashing names, ids that repeat with other texts or sources, odd and empty tables, stages of the pipeline."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from larkspur.llm import common, licences, lsh_forest, mixing, quality, suffix_dedup

#: Names that the operators use themselves, or did.
OWN = """key hash id start component spans shard slot kept block a b weight size text_hash text_hash_ hash_of id_of _key _kept _k _h _id _hash _spans _gone _text_hash text_key source_name
source_of one two label stays signature doc set family x y outside xs ys token digest strings twice asked content epoch take first last log_weight gumbel_key order bin row value _w _chunk _local _offset""".split()


def sentence(word: str, n: int = 60) -> str:
    return " ".join(f"{word}{i}" for i in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None), (2, "", "a"), (3, " \n\t", "a"), (4, "one", None), (5, "x" * 3000, "b"), (6, "ab " * 2000, "b"), (7, sentence("p"), "c"), (7, sentence("p"), "c"), (7, sentence("p"), "d"), (7, sentence("q"), "c"), (None, sentence("p"), "c"), (None, None, None), (8, sentence("p", 59), "a")]
    base = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return base.withColumns({c: F.lit(f"own {c}") for c in OWN}).withColumns({"n_chars": F.length("text").cast("long"), "lang": F.lit(None).cast("string")})


def labels_of(spark):
    return spark.createDataFrame([(7, 1, 0), (4, 0, 0), (5, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


MADE = {
    "repeats": lambda spark, d: suffix_dedup.deduplicated(d),
    "near": lambda spark, d: lsh_forest.drop_near_duplicates(d),
    "mix": lambda spark, d: mixing.mixed_documents(d),
    "quality": lambda spark, d: quality.keep_quality(d, labels_of(spark)),
}


@pytest.mark.parametrize("name", MADE)
def test_own_columns_come_through(spark, odd, name):
    out = MADE[name](spark, odd)
    assert out.dtypes == odd.dtypes
    rows = out.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in OWN)
    empty = MADE[name](spark, odd.where("false"))
    assert empty.dtypes == odd.dtypes and empty.collect() == []


def test_without_labels_all_are_as_likely(spark, odd):
    assert quality.keep_quality(odd, labels_of(spark).where("false")).count() > 0


def test_names_are_unused():
    assert common.unused(["Key", "hash", "hash_"], "key", "hash", "other", "other") == ["key_", "hash__", "other", "other_"]


def test_rows_of_one_id_stand_for_their_own_texts(spark):
    a, b, c = sentence("a"), sentence("b"), sentence("c")
    rows = [(5, a), (5, b), (6, a), (7, b), (5, b), (9, c), (9, c), (9, a + " more"), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in lsh_forest.drop_near_duplicates(docs).collect())
    assert got == Counter([(5, a), (5, b), (9, c), (None, a)])
    assert got == Counter((r.doc_id, r.text) for r in lsh_forest.drop_near_duplicates(docs.repartition(5)).collect())
    links = Counter((r.doc_id, r.component_id) for r in lsh_forest.near_duplicates(docs).collect())
    assert links == Counter({(5, 5): 3, (6, 5): 1, (7, 5): 1, (9, 9): 2, (9, 5): 1, (None, None): 1})


def test_a_key_without_end_is_taken_in_stretches(spark, monkeypatch):
    import random

    from . import brute

    rnd, texts = random.Random(5), []
    for base in (sentence("u", 80), sentence("v", 80)):
        for _ in range(120):
            words = base.split()
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = f"z{rnd.randrange(10**6)}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lsh_forest, "HELD", 20)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in lsh_forest.near_duplicates(docs, n=2).collect()}
    assert got == brute.near_rows(list(enumerate(texts)), n=2)


def test_one_id_under_two_sources_is_two_documents(spark):
    text, other = sentence("m", 10), sentence("o", 12)
    docs = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (2, other, "a")], "doc_id long, text string, source string")
    took = Counter()
    for r in mixing.mix_sources(docs).collect():
        took[r.doc_id] += r.taken
        assert r.taken <= 2 * r.size
    out = mixing.mixed_documents(docs).collect()
    assert sum(len(r.text.split()) for r in out) == sum(took.values())
    words = Counter()
    for r in out:
        words[r.doc_id, r.source] += len(r.text.split())
    assert all(n <= 2 * 12 for n in words.values())


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_and_empty_tables(spark, odd, stage, tmp_path):
    docs = odd.select(*corpus_pipeline.COLUMNS)
    labels_of(spark).write.parquet(f"{tmp_path}/labels.parquet")
    made = corpus_pipeline.STAGES[stage][1]
    made(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() > 0
    made(spark, docs.where("false"), str(tmp_path)).write.parquet(f"{tmp_path}/none")
    assert spark.read.parquet(f"{tmp_path}/none").count() == 0


def test_mix_by_plain_walk(spark):
    """The plan done again word by word: which words of each source the slots draw, without joins, runs or inverse permutations."""
    docs = spark.createDataFrame([(i, sentence(f"w{i}", 3 + i * 7 % 40), "abc"[i % 3]) for i in range(40)], "doc_id long, text string, source string")
    mix = mixing.plan_mix(docs, [], "doc_id", "text", "source", (5, 2, 1), 1.5, 2.0, 16, 17)
    owner: dict = {}
    for r in mix.rows.collect():
        for i in range(r.size):
            owner[r.source_no, r.start + i] = r.id
    sizes = Counter(s for s, _ in owner)
    assert all({at for s, at in owner if s == no} == set(range(n)) for no, n in sizes.items())
    took, drawn = Counter(), Counter()
    for r in mix.slots.collect():
        short = sizes[r.source_no] - 16 * r.block
        assert 0 < r["take"] <= min(16, short)
        drawn[r.source_no, r.epoch, r.block] += 1
        for at in range(16 * r.block, 16 * r.block + r["take"]):
            took[owner[r.source_no, at]] += 1
    assert max(drawn.values()) == 1
    got = {r.doc_id: r.taken for r in mixing.mix_sources(docs, block=16).collect()}
    assert got == {i: took[i] for i in got}


def test_long_expressions_and_many_tags_take_linear_time():
    import time

    began = time.time()
    text = " or ".join(["mit"] * 50_000)
    assert len(licences.parse_expression(text)) == 99_999
    phrases, marks = licences.automata(tuple(licences.BASE_PHRASES.items()), (), licences.TAGS)
    line = "SPDX-License-Identifier: MIT " * 5_000
    assert len(licences.scan_text(line, phrases, marks, licences.PERMISSIVE)[2]) == 5_000
    assert time.time() - began < 5


def test_words_of_the_code_are_in_the_fixture():
    import inspect

    quoted = {x for m in (lsh_forest, mixing, suffix_dedup, quality, common) for x in re.findall(r'alias\("(\w+)"\)', inspect.getsource(m))}
    assert {"key", "hash", "spans", "label", "stays"} <= quoted & set(OWN)
