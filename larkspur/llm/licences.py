"""Licence scans: Aho-Corasick finds notice phrases and identifier tags; a shunting-yard parser reads licence expressions."""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_batches

#: Phrases that are counted as base matches, and their labels (fixed values).
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices, whose labels are only added (fixed values).
NOTICE_PHRASES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2.0",
    "redistribution and use in source and binary forms": "bsd",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4": "cc-by",
    "cc by 3": "cc-by",
    "creative commons attribution": "cc-by",
    "cc0": "cc0",
    "all rights reserved": "all-rights-reserved",
}
#: Tags, lower case, after which an expression stands to the end of the line (fixed values).
TAGS = ("spdx-license-identifier:",)
#: How much one label of a kind says for the text being under a licence.
WEIGHTS = {"tag": 0.95, "base": 0.8, "notice": 0.6}
#: Labels that a reader may allow by default, for `permitted`.
PERMISSIVE = frozenset({"mit", "apache-2.0", "apache-2", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "cc0", "unlicense", "0bsd"})
#: Binding strength of operators.
BINDS = {"with": 3, "and": 2, "or": 1}

#: Bytes to words and blanks: A-Z to a-z; digits, letters and bytes from 0x80 on are of words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
EXPRESSION_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")


def parse_expression(text: str) -> list | None:
    """Reverse Polish form of a licence expression, by the shunting-yard algorithm; None if it isn't one.

    Operators are and, or, with (any case), `with` binding most and `or` least, all to the left. Text after the longest well-formed
    beginning, such as a comment's end, is not of the expression.
    """
    out, stack, best, wants, depth = [], [], None, True, 0
    for match in EXPRESSION_TOKEN.finditer(text):
        token = match[0].lower()
        if token in BINDS:
            if wants:
                break
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[token]:
                out.append(stack.pop())
            stack.append(token)
            wants = True
        elif token == "(":
            if not wants:
                break
            stack.append(token)
            depth += 1
        elif token == ")":
            if wants or not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        else:
            if not wants:
                break
            out.append((token,))
            wants = False
        if not wants and not depth:
            best = len(out), stack[::-1]  # at most one operator of each strength waits
    return None if best is None else out[: best[0]] + best[1]


def evaluate(polish: list, allowed: frozenset[str]) -> bool:
    """Whether the expression can be met with allowed licences: `or` needs a side, `and` both; an exception doesn't take away."""
    values: list[bool] = []
    for x in polish:
        if isinstance(x, tuple):
            values.append(x[0].removesuffix("+") in allowed)
        else:
            right, left = values.pop(), values.pop()
            values.append(left if x == "with" else left and right if x == "and" else left or right)
    return values[0]


def licences_of(polish: list) -> list[str]:
    """Licence identifiers of an expression, exceptions left out."""
    kept: list[list[str]] = []
    for x in polish:
        if isinstance(x, tuple):
            kept.append([x[0]])
        else:
            right, left = kept.pop(), kept.pop()
            kept.append(left if x == "with" else left + right)
    return kept[0]


@functools.lru_cache(4)
def automata(base: tuple, notices: tuple, tags: tuple):
    phrases, marks = ahocorasick.Automaton(), ahocorasick.Automaton()
    kinds: dict[str, list] = {}
    for kind, table in (("base", base), ("notice", notices)):
        for phrase, label in table:
            words = phrase.encode().translate(WORD_BYTES).split()
            kinds.setdefault(" " + b" ".join(words).decode("latin-1") + " ", []).append((kind, label, len(words)))
    for padded, found in kinds.items():
        phrases.add_word(padded, (len(padded), found))
    for tag in tags:
        marks.add_word(tag.lower().encode().translate(LOWER_BYTES).decode("latin-1"), len(tag.encode()))
    phrases.make_automaton()
    marks.make_automaton()
    return phrases, marks


def scan_text(text: str, phrases: ahocorasick.Automaton, marks: ahocorasick.Automaton, allowed: frozenset[str]) -> tuple:
    """Number of words, matches (first word, words, label, kind) and expressions (label text, permitted) of one text."""
    raw = text.encode()
    words = raw.translate(WORD_BYTES).split()
    joined = b" " + b" ".join(words) + b" "
    matches, at, before = [], 0, 0
    for end, (size, found) in phrases.iter(joined.decode("latin-1")):
        start = end - size + 1
        if start >= at:
            before += joined.count(b" ", at, start)
            at, word = start, before
        else:  # a longer phrase that ends later may begin earlier
            word = before - joined.count(b" ", start, at)
        matches += [(word, n, label, kind) for kind, label, n in found]
    expressions = []
    lower = raw.translate(LOWER_BYTES)
    if b":" in lower:
        found = list(marks.iter(lower.decode("latin-1")))
        for (end, _), (after, size) in zip(found, [*found[1:], (len(raw) + 1, 0)]):
            stop = raw.find(b"\n", end, after - size + 1)  # the line's end, or the next tag
            line = raw[end + 1 : stop if stop >= 0 else after - size + 1].decode("utf-8", "replace")
            polish = parse_expression(line)
            if polish:
                expressions.append((",".join(sorted(set(licences_of(polish)))), evaluate(polish, allowed)))
    return len(words), sorted(matches), expressions


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICE_PHRASES, tags: tuple[str, ...] = TAGS, allowed: frozenset[str] = PERMISSIVE) -> DataFrame:
    """Licence notices and tags of every whole text.

    Returns one row for each input row: the id column, n_words, matches (array of word, n_words, label, kind), expressions (array of
    licences, permitted) and score (0 to 1: one less the product, over labels, of one less the weight of the label's strongest kind).
    Words are runs of digits, letters and characters from U+0080 on, with A-Z in lower case; a phrase matches where its words stand
    one after another. A null text counts as empty: no words, no matches, score 0. Null ids and repeated rows are kept, an
    empty table gives an empty one, other columns are not looked at, and overlapping matches all count.
    """
    text_batches(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    tables = (tuple(base.items()), tuple(notices.items()), tuple(tags))

    def run(batches):
        phrases, marks = automata(*tables)
        for batch in batches:
            ids, texts = batch.columns
            counts, found, read, scores = [], [], [], []
            for text in texts.to_pylist():
                n, matches, expressions = scan_text(text or "", phrases, marks, allowed)
                counts.append(n)
                found.append([{"word": w, "n_words": k, "label": label, "kind": how} for w, k, label, how in matches])
                read.append([{"licences": x, "permitted": ok} for x, ok in expressions])
                sure: dict[str, float] = {}
                for label, weight in [*((m[2], WEIGHTS[m[3]]) for m in matches), *((x, WEIGHTS["tag"]) for names, _ in expressions for x in names.split(","))]:
                    sure[label] = max(weight, sure.get(label, 0.0))
                rest = 1.0
                for label in sorted(sure):
                    rest *= 1 - sure[label]
                scores.append(1 - rest)
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(found, MATCHES), pa.array(read, EXPRESSIONS), pa.array(scores, pa.float64())], names=["key", "n_words", "matches", "expressions", "score"])

    schema = f"key {kind}, n_words long, matches array<struct<word:long,n_words:int,label:string,kind:string>>, expressions array<struct<licences:string,permitted:boolean>>, score double"
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", id_col)


MATCHES = pa.list_(pa.struct([("word", pa.int64()), ("n_words", pa.int32()), ("label", pa.string()), ("kind", pa.string())]))
EXPRESSIONS = pa.list_(pa.struct([("licences", pa.string()), ("permitted", pa.bool_())]))
