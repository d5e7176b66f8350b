"""The functions that Spark has no native form of, or a slow one, over Arrow batches."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F

from .text import SHAPES


def _fold(texts: pd.Series) -> pd.Series:
    table = str.maketrans(SHAPES)
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t.translate(table)) if not unicodedata.combining(c)))


def folded(x: Column) -> Column:
    """As text.comparable, for every script."""
    return F.pandas_udf(_fold, "string")(x)


def visible_text(html: str | None) -> str | None:
    """Data between tags, joined by blanks and collapsed; markup left open at the end is not text."""
    if html is None:
        return None
    words: list[str] = []
    parser = HTMLParser(convert_charrefs=True)
    parser.handle_data = lambda data: words.extend(data.split())
    parser.feed(html)
    return " ".join(words)


def html_text(x: Column) -> Column:
    return F.pandas_udf(_html, "string")(x)


def _html(texts: pd.Series) -> pd.Series:
    return texts.map(visible_text)


#: Different words that a task holds before it gives them out.
WORDS_HELD = 200_000


def different_words(keys: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (keys..., texts...): each word of their texts once for its keys, as far as a task sees; white space is that of `text.SPACE`. A row with a null text has none."""

    def run(batches):
        found, n, names, kinds = {}, 0, [], []

        def told():
            rows = [(*key, word) for key, words in found.items() for word in words]
            columns = zip(*rows) if rows else [()] * (keys + 1)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            names, kinds = [*batch.schema.names[:keys], "t"], [*batch.schema.types[:keys], pa.string()]
            parts = (batch.slice(at, 500) for at in range(0, batch.num_rows, 500))
            for row in (row for part in parts for row in zip(*(c.to_pylist() for c in part.columns))):
                if None not in row[keys:]:
                    words = found.setdefault(row[:keys], set())
                    n -= len(words)
                    for text in row[keys:]:
                        words.update(text.split())
                    n += len(words)
                    if n > WORDS_HELD:
                        yield told()
                        found, n = {}, 0
        if found:
            yield told()

    return run


def _places(text: str) -> dict[str, int]:
    """Each letter's places in a text, as the bits of a number."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _common(places: dict[str, int], n: int, other: str) -> int:
    """Length of the longest common subsequence of another text and the one of n letters whose places these are."""
    every = (1 << n) - 1
    rest = every
    for c in other:
        met = rest & places.get(c, 0)
        rest = (rest + met | rest - met) & every
    return n - rest.bit_count()


def ratio(new: str, old: str) -> float:
    """Ratcliff-Obershelp ratio; its order matters: the new text first."""
    return difflib.SequenceMatcher(None, new, old).ratio()


#: Counters that letters, and pairs of letters, are hashed to.
LETTERS, PAIRS = 32, 96


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _shape(text: str) -> np.ndarray:
    codes = _codes(text).astype(np.int64)
    letters = np.bincount(codes % LETTERS, minlength=LETTERS)
    return np.concatenate([letters, np.bincount((codes[:-1] * 131 + codes[1:] * 7) % PAIRS, minlength=PAIRS)]).astype(np.int32)


#: Texts of at most so many letters, of at most so many kinds, are compared many pairs at once, so many of them.
SHORT, KINDS, AT_ONCE = 512, 400, 8192


def _commons(mine: list[str], others: list[str]) -> Callable[[np.ndarray, np.ndarray], np.ndarray] | None:
    """What gives, for pairs (i of mine, j of others), the lengths of their longest common subsequences, as `_common` does; None where texts are long or letters many.

    A pair's places are 64 at a time in a row of words, and each step takes the next letter of all pairs' other texts.
    """
    words = -(-max(map(len, mine), default=0) // 64)
    if not words or max(map(len, mine)) > SHORT or max(map(len, others), default=0) > 2 * SHORT:
        return None
    kinds = np.unique(np.concatenate([_codes(t) for t in mine]))
    if len(kinds) > KINDS:
        return None
    places = np.zeros((words, len(mine) * (len(kinds) + 1)), np.uint64)
    for i, t in enumerate(mine):
        at, row = np.arange(len(t)), np.searchsorted(kinds, _codes(t)) + i * (len(kinds) + 1)
        np.bitwise_or.at(places, (at // 64, row), np.uint64(1) << (at % 64).astype(np.uint64))
    sizes = np.array([len(t) for t in others], np.int64)
    letters = np.full((sizes.max(initial=1), len(others)), len(kinds), np.int32)  # the last kind is that of no letter
    for j, t in enumerate(others):
        kind = np.searchsorted(kinds, codes := _codes(t))
        letters[: len(t), j] = np.where(kinds[np.minimum(kind, len(kinds) - 1)] == codes, kind, len(kinds))

    def run(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        order = np.argsort(-sizes[j], kind="stable")
        i, j = i[order], j[order]
        row = letters[: sizes[j].max(initial=0), j] + (i * (len(kinds) + 1)).astype(np.int32)
        going = np.searchsorted(-sizes[j], -np.arange(len(row)), "left")  # pairs whose other text has a letter there
        rest = np.full((words, len(i)), ~np.uint64(0))
        for step, n in enumerate(going.tolist()):
            carry = None
            for w in range(words):
                open_ = rest[w, :n]
                met = places[w].take(row[step, :n])
                met &= open_
                total = open_ + met
                over = total < open_ if w + 1 < words else None
                if carry is not None:
                    total += carry
                    over = over | (total < carry) if over is not None else None
                open_ ^= met
                open_ |= total
                carry = over
        out = np.empty(len(i), np.int64)
        out[order] = 64 * words - np.bitwise_count(rest).sum(0, dtype=np.int64)
        return out

    return run


def close_pairs(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Of a block of titles (side, pos, title): those of side 0 with those of sides 1 and 2 whose ratio is at least the threshold; on side 1 only with earlier ones.

    With S letters in both, matching blocks hold at least threshold * S / 2 letters and are at most S + 1 less twice these many, and a block of n letters holds
    n - 1 letter pairs. What counts of letters and of pairs can't reach is not looked at further. The longest common subsequence is no shorter than the blocks.
    """

    def run(table: pa.Table) -> pa.Table:
        side, pos, titles = table.column("side").to_numpy(), table.column("pos").to_numpy(), table.column("title").to_pylist()
        size = np.array([len(t) for t in titles], np.int64)
        shapes = np.stack([_shape(t) for t in titles])
        near, far = np.flatnonzero(side == 0), np.flatnonzero(side > 0)
        far = far[np.argsort(size[far], kind="stable")]
        sizes, far_pairs = size[far], shapes[far, LETTERS:]
        # Letter by letter, and in two bytes where they do: most pairs end here.
        far_letters = np.ascontiguousarray(shapes[far, :LETTERS].T.astype(np.uint16 if size.max(initial=0) < 1 << 16 else np.int32))
        commons = _commons([titles[i] for i in near], [titles[j] for j in far])
        out: list[tuple[int, int, float]] = []
        least = threshold / (2 - threshold)

        def settle(i: int, j: int) -> None:
            old, new = (i, j) if pos[i] < pos[j] else (j, i)
            found = ratio(titles[new], titles[old])
            if found >= threshold:
                out.append((int(pos[old]), int(pos[new]), found))

        def compare(x: np.ndarray, at: np.ndarray) -> None:
            enough = 2 * commons(x, at) >= threshold * (size[near[x]] + sizes[at]) - 1e-6
            for i, j in zip(near[x[enough]].tolist(), far[at[enough]].tolist()):
                settle(i, j)

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for x, i in enumerate(near.tolist()):
            low, high = np.searchsorted(sizes, [np.floor(size[i] * least), np.ceil(size[i] / least) + 1])
            both = np.zeros(high - low, far_letters.dtype)
            for letter, n in enumerate(shapes[i, :LETTERS].astype(far_letters.dtype)):
                if n:
                    both += np.minimum(far_letters[letter, low:high], n)
            at = low + np.flatnonzero(2 * both.astype(np.int64) >= threshold * (size[i] + sizes[low:high]) - 1e-6)
            at = at[(side[far[at]] == 2) | (pos[far[at]] < pos[i])]
            at = at[np.minimum(far_pairs[at], shapes[i, LETTERS:]).sum(1) >= (1.5 * threshold - 1) * (size[i] + sizes[at]) - 1 - 1e-6]
            if commons is not None:
                held.append((np.full(len(at), x), at))
                if sum(len(h[0]) for h in held) >= AT_ONCE:
                    compare(*map(np.concatenate, zip(*held)))
                    held = []
                continue
            places = _places(titles[i]) if len(at) else {}
            for j in far[at].tolist():
                if 2 * _common(places, len(titles[i]), titles[j]) >= threshold * (size[i] + size[j]) - 1e-6:
                    settle(i, j)
        if held:
            compare(*map(np.concatenate, zip(*held)))
        early, late, ratios = zip(*out) if out else ((), (), ())
        return pa.table({"early": pa.array(early, pa.int64()), "late": pa.array(late, pa.int64()), "ratio": pa.array(ratios, pa.float64())})

    return run
