"""The whole-brief query is given whole relations."""

from __future__ import annotations

from larkspur.plans import catalogue
from larkspur.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_brief_gets_all_games(spark, monkeypatch):
    given = []
    monkeypatch.setattr(catalogue, "brief", lambda articles, games, *rest, **rules: given.append((articles.count(), games.count())))
    catalogue.brief_messages(spark, SF)
    assert given == [(T.articles(spark, SF).count(), T.games(spark, SF).count())]
