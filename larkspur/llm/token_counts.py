"""Exact token counts at every prefix of a text, by dynamic programming over prefixes."""

from __future__ import annotations

import bisect
import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import MOST_WORDS, PATTERN, Merges, read_vocabulary, splitter
from .common import text_batches, untracked


def blank(word: str) -> bool:
    """White space as the pattern has it (Python's own also holds U+001C to U+001F)."""
    return word.isspace() and not any("\x1c" <= c <= "\x1f" for c in word)


class PrefixCounts(dict):
    """Splits of a text (as text) to the token counts of each of their prefixes, by bytes; entry 0 is the empty prefix.

    The recurrence: the encoding of a prefix is that of a shorter prefix plus the one token that may follow its last token, so
    counts[i] = counts[i - len(token)] + 1. Candidates for the token are the suffixes of the prefix, longest first.
    """

    def __init__(self, path: str):
        _, order, self.special = read_vocabulary(path)
        self.merges = Merges(order)
        self.older: dict[str, bytes | list[int]] = {}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def __missing__(self, word: str) -> bytes | list[int]:
        if len(self) > MOST_WORDS:
            self.older = dict(self)
            self.clear()
        found = self.older.get(word)
        if found is None:
            counts = self.table(word.encode())
            found = bytes(counts) if max(counts) < 256 else counts
        self[word] = found
        return found

    def table(self, data: bytes) -> list[int]:
        order, longest, fits, whole = self.merges.order, self.merges.longest, self.merges.may_follow, self.merges.is_token
        counts, last = [0], [b""]
        for end in range(1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = data[start:end]
                if token in order and whole(token) and (not start or fits(last[start], token)):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
        return counts


@functools.lru_cache(2)
def prefix_counts(path: str) -> PrefixCounts:
    return PrefixCounts(path)


class Prefixes:
    """Token counts of all prefixes of one text, each what the library gives when it encodes that prefix alone.

    A prefix that ends inside white space takes the whole run up to there as one split, a prefix that ends inside a contraction
    takes the apostrophe and the letters apart, and a prefix that ends inside a special string takes it as common text.
    """

    def __init__(self, text: str, path: str, pattern: str = PATTERN):
        self.text, tables = text, prefix_counts(path)
        #: Start (in characters), tokens before, split and whether it is a special token, of each stretch.
        self.starts: list[int] = []
        self.parts: list[tuple[int, str, list[int] | None]] = []
        at = total = 0
        for i, piece in enumerate(tables.cut.split(text) if tables.cut else [text]):
            if i % 2:
                base, before = self.base(total), at
                tail = Prefixes.__new__(Prefixes)
                tail.text, tail.starts, tail.parts = "", [], []
                tail.read(base[1] + piece, 0, 0, tables, pattern)
                self.starts.append(before)
                self.parts.append((total, piece, [base[0] + tail.count(len(base[1]) + n) for n in range(len(piece))] + [total + 1]))
                total, at = total + 1, at + len(piece)
            else:
                total, at = self.read(piece, at, total, tables, pattern), at + len(piece)
        self.total = total

    def base(self, total: int) -> tuple[int, str]:
        """Tokens before the last few splits, and those splits' text: where a special string's letters could join."""
        k = len(self.parts)
        while k and self.parts[k - 1][2] is None and len(self.parts) - k < 2:
            k -= 1
        return (self.parts[k][0] if k < len(self.parts) else total), "".join(p[1] for p in self.parts[k:])

    def read(self, text: str, at: int, total: int, tables: PrefixCounts, pattern: str) -> int:
        """Add the splits of a text without special strings; gives the tokens so far."""
        run = ""
        for word in splitter(pattern).findall(text):
            counts = tables[word]
            if blank(word) and run:  # the run goes on: "\n\n" before a letter is two splits, as a prefix it is one
                start, before = self.starts[-1], self.parts[-1][0]
                run += word
                self.parts[-1] = (before, run, None)
                total += counts[-1]
                at += len(word)
                continue
            run = word if blank(word) else ""
            self.starts.append(at)
            self.parts.append((total, word, None))
            total += counts[-1]
            at += len(word)
        self.tables = tables
        return total

    def count(self, n: int) -> int:
        """Tokens of the first n characters."""
        if n <= 0 or not self.starts:
            return 0
        k = bisect.bisect_left(self.starts, n) - 1
        before, word, special = self.parts[k]
        inside = n - self.starts[k]
        if special is not None:
            return special[inside]
        tables = self.tables
        if word[0] == "'" and 1 < inside < len(word) and word[1:2].isalpha():
            return before + tables["'"][-1] + tables[word[1:inside]][-1]
        if inside == 1 and word[0] == " " and len(word) > 1 and k and blank(self.parts[k - 1][1]):  # the blank joins the run before it
            return self.parts[k - 1][0] + tables[self.parts[k - 1][1] + " "][-1]
        return before + tables[word][len(word[:inside].encode())]

    def longest(self, budget: int) -> int:
        """Characters of the longest prefix of at most `budget` tokens."""
        k = bisect.bisect_right([p[0] for p in self.parts], budget)
        first = max(0, k - 2)
        end = len(self.text) if k >= len(self.parts) else self.starts[k]
        low = self.starts[first] if self.parts else 0
        while end > low and self.count(end) > budget:
            end -= 1
        return end


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", with_prefix: bool = True) -> DataFrame:
    """Token counts of every whole text, and the longest prefix that stays within `limit`.

    Returns one row for each input row: the id column, n_bytes, n_tokens, over_limit, and if with_prefix, prefix_chars (the
    characters of the longest prefix of at most `limit` tokens). Special strings inside a text count one token each, as is the
    library's default. A null text counts as empty (0, 0, false, 0); null ids and repeated rows are kept; an empty table gives an
    empty one; other columns are not looked at. Other budgets can be asked of `Prefixes` without encoding again.
    """
    text_batches(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        with untracked():
            yield from made(batches)

    def made(batches):
        tables, split = prefix_counts(path), splitter(PATTERN)
        for batch in batches:
            ids, texts = batch.columns
            sizes, counts, fitting = [], [], []
            for text in texts.to_pylist():
                text = text or ""
                total = 0
                for i, piece in enumerate(tables.cut.split(text) if tables.cut and any(x in text for x in tables.special) else [text]):
                    total += 1 if i % 2 else sum([tables[w][-1] for w in split.findall(piece)])
                sizes.append(len(text.encode()))
                counts.append(total)
                if with_prefix:
                    fitting.append(len(text) if total <= limit else fit(text, path, limit))
            out = [ids, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(fitting, pa.int64())] * with_prefix, names=["key", "n_bytes", "n_tokens", "over_limit", *["prefix_chars"] * with_prefix])

    schema = f"key {kind}, n_bytes long, n_tokens long, over_limit boolean" + ", prefix_chars long" * with_prefix
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", id_col)


def fit(text: str, path: str, limit: int) -> int:
    """Characters of the longest prefix of at most `limit` tokens, of a text that has more.

    What is past the limit doesn't change the counts of the prefixes up to it but for the split it stands in, so a stretch of the
    text is enough if it has clearly more tokens than the limit; stretches double until that holds.
    """
    stretch = 8 * limit + 256
    while True:
        part = Prefixes(text[:stretch], path)
        if stretch >= len(text) or part.parts[-1][0] > limit + 4 and len(part.parts) > 8 and part.parts[-4][0] > limit:
            return part.longest(limit)
        stretch *= 2
