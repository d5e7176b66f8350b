"""Quality models on labels they were not fitted on, whole: every held-out row counts, whatever its language."""

from __future__ import annotations

import pytest

from larkspur.llm import quality

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("half", [0, 1])
def test_toxic_texts_go_in_every_language(spark, half):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in quality.resample(docs, labels.where(f"doc_id % 2 = {1 - half}")).select("doc_id").collect()}
    held: dict = {}
    for r in docs.join(labels.where(f"doc_id % 2 = {half}"), "doc_id").select("doc_id", "lang", "quality", "toxic").collect():
        kind = "toxic" if r.toxic else "clean" if r.quality == 1 else "low"
        held.setdefault((kind, r.lang), []).append(r.doc_id in kept)
    share = {k: sum(v) / len(v) for k, v in held.items()}
    print({k: f"{sum(v)} of {len(v)}" for k, v in sorted(held.items())})
    assert all(share["toxic", lang] < 0.1 for lang in ("en", "fr", "de"))
    assert share["toxic", "es"] < 0.5  # some 16 toxic rows to learn from
    assert all(share["clean", lang] > 0.95 for lang in ("en", "fr", "de", "es"))
