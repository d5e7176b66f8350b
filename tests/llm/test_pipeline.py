"""The pipeline's stages: columns, effects and what they leave alone."""

from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from . import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_in_order_and_columns(stages, spark):
    assert len(corpus_pipeline.STAGES) == 5
    columns = spark.read.parquet(f"{SF}/documents.parquet").dtypes
    assert all(s.dtypes == columns for s in stages[:-1])


def test_near_duplicates_leave_one_of_each_group(stages):
    before = [(r.doc_id, r.text) for r in stages[0].collect()]
    want = {c for _, c in brute.near_rows(before, n=5).values()}
    assert {r.doc_id for r in stages[1].collect()} == want


def test_repeats_are_gone_and_the_rest_stays(stages):
    before = {r.doc_id: r.text for r in stages[1].collect()}
    rows = dict(zip(before, brute.repeat_rows(list(before.values()))))
    for r in stages[2].collect():
        size, gone, *_ = rows[r.doc_id]
        assert r.n_chars == len(r.text)
        assert size - gone <= len(r.text.encode()) <= size - gone + 6 * rows[r.doc_id][2]
        if not gone:
            assert r.text == before[r.doc_id]


def test_mix_takes_words_of_the_texts(stages):
    before = {r.doc_id: Counter(r.text.split()) for r in stages[2].collect()}
    for r in stages[3].collect():
        assert not Counter(r.text.split()) - before[r.doc_id]


def test_last_stage_encodes_what_it_got(stages):
    texts = Counter(hashlib.sha256(r.text.encode()).hexdigest() for r in stages[3].collect())
    rows = stages[4].collect()
    assert Counter(r.decoded_sha256 for r in rows) == texts
    for r in rows[:50]:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()


def test_run_gives_the_last_stage(spark, stages):
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.ids_sha256) for r in stages[-1].collect())
