"""Near-duplicate titles meet whatever their sources."""

from __future__ import annotations

import difflib
import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions import arrow, text as X
from larkspur.plans.catalogue import QUERIES
from larkspur.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_pairs_of_all_sources(spark):
    rows = T.articles(spark, SF).select("pos", "source", X.normalised_title(F.col("title")).alias("t")).collect()
    titles, sources = {r.pos: r.t for r in rows}, {r.pos: r.source for r in rows}
    got = {(r.early, r.late) for r in QUERIES["near_dup_pairs"](spark, SF).collect()}
    first: dict = {}
    for p in sorted(titles):
        first.setdefault(titles[p], p)
    want = {(first[t], p) for p, t in titles.items() if first[t] != p}
    heads = sorted(first.values())
    for i, a in enumerate(heads):
        for b in heads[i + 1 :]:
            matcher = difflib.SequenceMatcher(None, titles[b], titles[a])
            if matcher.real_quick_ratio() >= 0.85 and matcher.quick_ratio() >= 0.85 and matcher.ratio() >= 0.85:
                want.add((a, b))
    assert got == want and any(sources[a] != sources[b] for a, b in got)


@pytest.mark.parametrize("seed", range(3))
def test_bound_is_never_below_the_matcher(seed):
    rng = random.Random(seed)
    for _ in range(200):
        a = "".join(rng.choices("abcdé ", k=rng.randint(0, 240)))
        b = "".join(c for c in a if rng.random() > 0.1) if rng.random() < 0.5 else "".join(rng.choices("abcdé ", k=rng.randint(0, 240)))
        blocks = sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
        assert blocks <= arrow._common(arrow._places(b), len(b), a) <= min(len(a), len(b))
