"""Removal of repeated passages: a sparse suffix array, range-partitioned by sampled splitters.

Every string of `length` bytes has one anchor: the place, among the starts of its 24-byte tokens, of the smallest token hash. Equal
strings have equal anchors, so it is enough to sort the suffixes that begin at anchors, about one in 90 places, with the bytes before
them that strings with this anchor reach back to. A stretch of neighbouring strings with one anchor is a *run*.

Runs go to ranges of their leading token, the splitters taken from a sample's quantiles. Equal runs are counted first, whole. Within a range, the
strings of runs that differ are sorted by multikey quicksort: by 8 bytes, then equal ones by the next 8, and so on to both ends. A token
with too many runs for one task lies across range boundaries; its strings are dealt over all tasks and compared across boundaries by their digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import lean, text_batches, unused, written

#: Bytes of the leading token.
TOKEN = 24
#: Bytes of text whose anchors are found together.
AT_ONCE = 1_000_000
#: Runs of a range, about, and the most ranges.
RANGE_RUNS, MOST_RANGES = 4_000, 50_000
#: Runs of a token beyond which it lies across boundaries.
TOKEN_RUNS = 50_000
#: Texts that a task remembers, so that it takes each of their copies once.
REMEMBERED = 100_000


def token_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the TOKEN bytes from each place on (len - TOKEN + 1 places)."""
    n = len(data) - TOKEN + 1
    words = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1)).reshape(-1, 8)
    words = np.ascontiguousarray(words).view(np.uint64).reshape(-1)
    out = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    for at in range(8, TOKEN, 8):
        out += words[at : at + n]
        out *= np.uint64(0xD1B54A32D192ED03)
        out ^= out >> np.uint64(32)
    return out


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def find_runs(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Runs of texts: text, first string's start, number of strings, token hash, and offset of the anchor from the first start."""
    long = [i for i, t in enumerate(texts) if len(t) >= length]
    none = np.empty(0, np.int64)
    if not long:
        return none, none, none, none.astype(np.uint64), none
    data = np.frombuffer(b"".join(texts[i] for i in long), np.uint8)
    sizes = np.array([len(texts[i]) for i in long], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    hashes = token_hashes(data)
    places = np.arange(len(hashes), dtype=np.uint64)
    # The place in the low bits settles ties: the leftmost of equal tokens.
    packed = (hashes & ~np.uint64((1 << 32) - 1)) | places
    anchors = (smallest(packed, length - TOKEN + 1) & np.uint64((1 << 32) - 1)).astype(np.int64)
    starts = np.arange(len(anchors))
    text = np.repeat(np.arange(len(long)), sizes)[: len(anchors)]
    inside = starts + length <= bounds[text + 1]
    starts, anchors, text = starts[inside], anchors[inside], text[inside]
    new = np.ones(len(starts), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.concatenate([first, [len(starts)]]))
    own = text[first]
    return np.array(long, np.int64)[own], starts[first] - bounds[own], counts, hashes[anchors[first]], anchors[first] - starts[first]


def split_batches(texts: list[bytes], at_once: int = AT_ONCE):
    """Bounds of stretches of texts of about at_once bytes; one longer text stands alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > at_once:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans [first, last), sorted, those that touch or overlap taken together."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def repeated(contents: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each run of one token, which of its strings come again in another run or twice in itself.

    Strings are numbered; multikey quicksort sorts numbers by 8 bytes at a time, and goes on with those equal to a neighbour only.
    """
    sizes = np.array(counts, np.int64)
    begins = np.concatenate([[0], np.cumsum([len(c) for c in contents])])[:-1]
    run = np.repeat(np.arange(len(contents)), sizes)
    ordinal = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = begins[run] + ordinal
    data = np.frombuffer(b"".join(contents) + bytes(8), np.uint8)
    words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))).view(np.uint64).reshape(-1)
    live = np.arange(len(run))
    group = np.zeros(len(run), np.int64)
    # From the middle outward: the anchor's token is common to all, what tells strings apart lies far from it.
    offsets = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])
    offsets = [offsets[i // 2 if i % 2 == 0 else -1 - i // 2] for i in range(len(offsets))]
    for at in offsets:
        value = words[place[live] + at]
        order = np.lexsort((value, group))
        live, group, value = live[order], group[order], value[order]
        new = np.ones(len(live), bool)
        new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        group = np.cumsum(new)
        alone = new & np.append(new[1:], True)
        live, group = live[~alone], group[~alone]
        if not len(live):
            break
    hit = np.zeros(len(run), bool)
    hit[live] = True
    return np.split(hit, np.cumsum(sizes)[:-1])


def spans_of(hit: np.ndarray, length: int, start: int = 0) -> list[tuple[int, int]]:
    """Bytes covered by the strings marked."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    firsts, lasts = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    return [(start + int(a), start + int(b) + length) for a, b in zip(firsts, lasts)]


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
SPANS_SQL = "array<struct<first:bigint,last:bigint>>"


def as_spans(found: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"first": a, "last": b} for a, b in x] for x in found], SPANS)


def repeated_spans(texts: DataFrame, once: DataFrame, length: int) -> DataFrame:
    """For each text (key, text; rows of one key are equal, `once` has one of each): the spans covered by strings that start more than once. Rows (key, spans).

    Copies are let go where a task meets them again, and those of other tasks where runs are gathered, so no row grows with the number of copies.
    """
    text_batches(texts.sparkSession)

    def anchor(batches):
        """Runs, and with a null token the spans that a text repeats within itself."""
        known: set[bytes] = set()
        for batch in batches:
            if len(known) > REMEMBERED:
                known.clear()
            keys, raw = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key not in known:
                    known.add(key)
                    keys.append(key)
                    raw.append(text.encode())
            for a, b in split_batches(raw):
                part = raw[a:b]
                text, start, strings, token, lead = find_runs(part, length)
                digests = np.array([xxhash.xxh3_64_intdigest(part[t][s : s + n + length - 1]) for t, s, n in zip(text.tolist(), start.tolist(), strings.tolist())], np.uint64)
                kind = np.stack([text.astype(np.uint64), token, digests], 1)
                order = np.lexsort((start, digests, token, text))
                same = np.zeros(len(order), bool)
                if len(order) > 1:
                    same[1:] = (kind[order[1:]] == kind[order[:-1]]).all(1)
                again = same | np.append(same[1:], False) if len(order) else same
                own: dict[int, list[tuple[int, int]]] = {}
                for i in order[again].tolist():
                    own.setdefault(int(text[i]), []).append((int(start[i]), int(start[i] + strings[i] + length - 1)))
                kept = order[~same] if len(order) else order
                twice = again[~same] if len(order) else same
                spans: list[list[tuple[int, int]] | None] = [None] * len(kept)
                rows = [[keys[a + t] for t in text[kept].tolist()], token[kept].view(np.int64).tolist(), digests[kept].view(np.int64).tolist(), start[kept].tolist(), strings[kept].tolist(), twice.tolist(), spans]
                for t, found in own.items():
                    for column, value in zip(rows, (keys[a + t], None, None, None, None, None, merged(found))):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int32()), pa.array(rows[5], pa.bool_()), pa.array([None if x is None else [{"first": f, "last": e} for f, e in x] for x in rows[6]], SPANS)], names=["key", "token", "digest", "start", "strings", "twice", "spans"])

    found = written(texts.select("key", "text").mapInArrow(lean(anchor), f"key binary, token long, digest long, start long, strings int, twice boolean, spans {SPANS_SQL}"))
    runs = found.where("token is not null")
    # Equal runs, whole: one stands for all. `at` tells where its bytes are; copies of one text have the same places, so count once here.
    place = F.xxhash64("key", "start")
    kinds = runs.groupBy("token", "digest", "strings").agg(F.max("twice").alias("twice"), F.min(F.struct("key", "start")).alias("at"), F.min(place).alias("low"), F.max(place).alias("high"))
    per_token = kinds.groupBy("token").agg(F.count("*").alias("kinds"))
    # A run that comes again is repeated whole; one whose token has other runs may be in part.
    kinds = written(kinds.join(per_token.where("kinds > 1"), "token", "left").select("token", "digest", "strings", "at", ((F.col("low") != F.col("high")) | F.col("twice")).alias("whole"), F.col("kinds").isNotNull().alias("open"), (F.coalesce("kinds", F.lit(0)) > TOKEN_RUNS).alias("across")).where("whole or open"))
    open_kinds = kinds.where("open")
    n_open = open_kinds.count()
    ranges = max(1, min(MOST_RANGES, n_open // RANGE_RUNS + 1))
    splitters = [] if ranges == 1 else open_kinds.agg(F.percentile_approx("token", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    edges = np.array(sorted(set(splitters)), np.int64)

    def cut(batches):
        """Bytes of the runs asked for."""
        for batch in batches:
            texts_, asked = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(texts_), 64):
                rows: list[tuple] = []
                for text, want in zip(texts_[a : a + 64], asked[a : a + 64]):
                    raw = text.encode()
                    rows += [(r["token"], r["digest"], r["strings"], r["across"], raw[r["start"] : r["start"] + r["strings"] + length - 1]) for r in want]
                token, digest, strings, across, content = zip(*rows)
                token = np.array(token, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(edges, token, "right").astype(np.int32)), pa.array(token), pa.array(digest, pa.int64()), pa.array(strings, pa.int32()), pa.array(content, pa.binary()), pa.array(across, pa.bool_())], names=["range", "token", "digest", "strings", "content", "across"])

    asked = open_kinds.groupBy(F.col("at.key").alias("key")).agg(F.collect_list(F.struct("token", "digest", "strings", "across", F.col("at.start").alias("start"))).alias("asked"))
    # All columns of `once` are taken, here and by the caller, so that both read one shuffle.
    contents = once.join(asked, "key").select("text", "asked", "copies").mapInArrow(lean(cut), "range int, token long, digest long, strings int, content binary, across boolean")
    result = f"token long, digest long, strings int, spans {SPANS_SQL}"

    def sort_ranges(batches):
        """Strings that come again, token by token; a token's runs stand together."""
        held: pa.Table | None = None

        def done(table: pa.Table):
            token = table.column("token").to_numpy()
            content, strings = table.column("content").to_pylist(), table.column("strings").to_pylist()
            spans: list[list[tuple[int, int]]] = []
            cuts = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]])
            first = 0
            for at in range(1, len(cuts)):  # some tokens together: a string's own token keeps it from those of others
                if at + 1 == len(cuts) or cuts[at + 1] - cuts[first] > 4000:
                    part = slice(int(cuts[first]), int(cuts[at]))
                    if part.stop > part.start:
                        spans += [spans_of(h, length) for h in repeated(content[part], strings[part], length)]
                    first = at
            return pa.RecordBatch.from_arrays([table.column(c).combine_chunks() for c in ("token", "digest", "strings")] + [as_spans(spans)], names=["token", "digest", "strings", "spans"])

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            token = held.column("token").to_numpy()
            end = int(np.searchsorted(token, token[-1], "left"))
            if held.num_rows >= 8000 and end:
                yield done(held.slice(0, end))
                held = held.slice(end).combine_chunks()
        if held is not None and held.num_rows:
            yield done(held)

    inner = contents.where("not across").drop("across").repartition(ranges, "range").sortWithinPartitions("token", "digest")
    partly = inner.drop("range").mapInArrow(lean(sort_ranges), result)
    if not open_kinds.where("across").isEmpty():
        partly = partly.unionByName(compare_across(contents.where("across"), length, result))
    whole = kinds.where("whole").select("token", "digest", "strings", F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.col("strings") + length - 1).cast("long").alias("last"))).alias("spans"))
    hits = whole.unionByName(partly.where(F.size("spans") > 0)).groupBy("token", "digest", "strings").agg(F.flatten(F.collect_list("spans")).alias("hits"))
    moved = runs.join(hits, ["token", "digest", "strings"]).select("key", F.transform("hits", lambda s: F.struct((s["first"] + F.col("start")).alias("first"), (s["last"] + F.col("start")).alias("last"))).alias("spans"))
    return moved.unionByName(found.where("token is null").select("key", "spans")).groupBy("key").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def compare_across(contents: DataFrame, length: int, result: str) -> DataFrame:
    """Repeated strings of the tokens that lie across boundaries: a row a string, counted by its 128-bit digest, ahead of the shuffle where it can be."""

    def strings(batches):
        for batch in batches:
            for token, digest, n, content in zip(*(batch.column(c).to_pylist() for c in ("token", "digest", "strings", "content"))):
                made = [xxhash.xxh3_128_digest(content[i : i + length]) for i in range(n)]
                ones = [int.from_bytes(x[:8], "little", signed=True) for x in made]
                twos = [int.from_bytes(x[8:], "little", signed=True) for x in made]
                yield pa.RecordBatch.from_arrays([pa.array([token] * n, pa.int64()), pa.array([digest] * n, pa.int64()), pa.array([n] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64())], names=["token", "digest", "strings", "at", "one", "two"])

    each = contents.mapInArrow(lean(strings), "token long, digest long, strings int, at long, one long, two long")
    again = each.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").select("one", "two")
    hit = each.join(again, ["one", "two"]).groupBy("token", "digest", "strings").agg(F.sort_array(F.collect_list("at")).alias("ats"))

    def spans(batches):
        for batch in batches:
            found = []
            for n, ats in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                mark = np.zeros(n, bool)
                mark[ats] = True
                found.append(spans_of(mark, length))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), as_spans(found)], names=["token", "digest", "strings", "spans"])

    return hit.mapInArrow(lean(spans), result)


def keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """(key, text): the key is the text's 128-bit digest, the text empty where it is null."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Both joins over this shall read one shuffle, so their plans must be alike: keys are never null, which an inner join would add and an outer one would
    # not, and coalescing to more parts than any table has moves nothing but keeps the optimiser from drawing the projection into one of the aggregations.
    return docs.select(F.unhex(F.md5(text)).alias("key"), text.alias("text")).where("key is not null").coalesce(1 << 20)


def without_repeats(docs: DataFrame, length: int, text_col: str) -> DataFrame:
    """For each different text: key, text, and the spans to remove."""
    texts = keyed(docs, text_col)
    once = texts.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    found = repeated_spans(texts, once, length)
    joined = once.join(found.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"), "left").drop("_key")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.octet_length("text").cast("long").alias("last")))
    return joined.select("key", "text", F.when((F.col("copies") > 1) & (F.octet_length("text") >= length), whole).otherwise(F.col("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What of each whole text stays when every byte goes that a string of `length` bytes covers which also starts elsewhere.

    Texts are UTF-8 bytes; strings don't cross texts; they are judged on the input, in other rows and in the same one, overlaps too. Returns one row
    for each input row: the id column, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and spans (array of first, last). A null text counts as
    empty; null ids are kept; repeated rows are copies of each other, so a text of `length` bytes or more in them goes whole; an empty table gives an
    empty one; other columns are not looked at.
    """

    def run(batches):
        for batch in batches:
            sizes, removed, numbers, digests, all_spans = [], [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = text.encode()
                spans = merged([(s["first"], s["last"]) for s in spans or []])
                sizes.append(len(raw))
                removed.append(sum(b - a for a, b in spans))
                numbers.append(len(spans))
                digests.append(hashlib.sha256(kept_bytes(raw, spans)).hexdigest())
                all_spans.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(numbers, pa.int64()), pa.array(digests), as_spans(all_spans)], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    judged = without_repeats(docs, length, text_col).mapInArrow(lean(run), f"key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {SPANS_SQL}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), F.unhex(F.md5(text)).alias("key"))
    return rows.join(judged, "key").drop("key")


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join(out) + raw[at:]


def deduplicated(docs: DataFrame, length: int = 200, text_col: str = "text") -> DataFrame:
    """The documents without their repeated passages, with the input's columns; n_chars, if there, follows the text.

    As `remove_repeats`, but a character stays whole if any of its bytes does. Rows whose text is null keep it; rows that lose everything keep an empty text, so all
    copies of a text of `length` bytes or more do; null ids and columns of any name stay as they are, and an empty table gives an empty one.
    """

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = text.encode()
                whole = []
                for a, b in merged([(s["first"], s["last"]) for s in spans or []]):
                    while a < b and a < len(raw) and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    whole.append((a, b))
                out.append(kept_bytes(raw, whole).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "kept"])

    own, key, kept = unused(docs.columns, "text_key", "key", "kept")
    cleaned = without_repeats(docs, length, text_col).where(F.size("spans") > 0).mapInArrow(lean(run), "key binary, kept string").select(F.col("key").alias(key), F.col("kept").alias(kept))
    rows = docs.withColumn(own, F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    rows = rows.join(cleaned, F.col(own) == F.col(key), "left")
    out = rows.withColumn(text_col, F.when(F.col(key).isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(F.col(kept)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(key).isNotNull(), F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
