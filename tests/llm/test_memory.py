"""What workers hold on to."""

from __future__ import annotations

from larkspur.llm import bpe, common, queries


def test_tasks_of_other_operators_empty_the_encoder_s_tables():
    path = queries.vocabulary(queries.VOCABULARY_RANKS)
    bpe.encode_text("some words", path)
    assert bpe.encoder.cache_info().currsize == 1
    assert list(common.lean(lambda batches: batches)(iter([1, 2]))) == [1, 2]
    assert bpe.encoder.cache_info().currsize == 0
    assert bpe.encode_text("some words", path) == bpe.encode_text("some words", path)
