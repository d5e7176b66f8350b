"""The registry without the training-text operators."""

from __future__ import annotations

import sys

import pytest

import __spark_entry__
from larkspur.plans.catalogue import QUERIES, SQL


def test_other_queries_stand_without_what_the_operators_need(monkeypatch):
    monkeypatch.setitem(sys.modules, "larkspur.llm", None)
    with pytest.warns(UserWarning, match="left out"):
        assert set(__spark_entry__.queries()) == set(QUERIES)
    with pytest.warns(UserWarning, match="left out"):
        assert set(__spark_entry__.oracle_sql()) == set(SQL)
