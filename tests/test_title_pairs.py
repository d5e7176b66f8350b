from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from larkspur.functions import arrow


def texts(n: int, most: int, letters: str = "abcde é\U0001f600") -> list[str]:
    dice = random.Random(n + most)
    return ["".join(dice.choices(letters, k=dice.randint(1, most))) for _ in range(n)] + ["x" * most, "x" * 64, "x" * 65][: 3 if most > 64 else 1]


def test_common_letters_many_pairs_at_once():
    for most in (1, 63, 64, 129, 400):
        mine, others = texts(20, most), texts(30, most + 7, "abcdef é?") + ["", "zz"]
        i, j = (x.ravel() for x in np.meshgrid(np.arange(len(mine)), np.arange(len(others))))
        want = [arrow._common(arrow._places(mine[a]), len(mine[a]), others[b]) for a, b in zip(i, j)]
        assert arrow._commons(mine, others)(i, j).tolist() == want


def test_short_titles_are_not_compared_one_by_one(monkeypatch):
    dice = random.Random(5)
    titles = ["".join(dice.sample("abcdefghij" * 12, 120)) for _ in range(40)]  # of equal letters, so only their order tells them apart
    titles += [t[:60] + "k" + t[60:] for t in titles[:10]]
    side, pos = [0] * 25 + [1] * 25, [*range(50, 25, -1), *range(25)]
    table = pa.table({"side": pa.array(side, pa.int32()), "pos": pa.array(pos, pa.int64()), "title": titles})
    calls, one = [], arrow._common
    monkeypatch.setattr(arrow, "_common", lambda *a: calls.append(a) or one(*a))
    found = {(r["early"], r["late"]) for r in arrow.close_pairs(0.85)(table).to_pylist()}
    assert found == {(15 + i, 50 - i) for i in range(10)}
    assert not calls
