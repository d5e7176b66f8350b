"""Quality by importance resampling: hashed n-gram models of target and raw text, their ratio sampled by Gumbel top-k."""

from __future__ import annotations

import math
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, lean, text_batches, unused

#: Buckets of hashed single-word features, of word pairs and of word beginnings.
WORD_BUCKETS, PAIR_BUCKETS, STEM_BUCKETS = 1 << 17, 1 << 16, 1 << 18
BUCKETS = WORD_BUCKETS + PAIR_BUCKETS + STEM_BUCKETS
#: Letters of a word's beginning: inflected or joined forms of a word are each too rare to be evidence, their beginning is not.
STEM = 5
#: Most labelled rows that models are fitted on; those of the smallest hashes are taken.
FIT_ROWS = 30_000
#: Rates of a bucket are drawn to the common one by so many counts.
DRAWN = 5.0
#: Log ratios are drawn to zero by so much. What differs by less, such as a language's share, adds up over long texts to more than faults do.
SHRUNK = 1.5
#: A bucket counts if its class counts differ from the expected ones by so many standard deviations.
CERTAIN = 5.0
#: For beginnings: so many standard deviations a bucket's counts differ by, and so many of its own log ratio are taken off that.
STEM_CERTAIN, STEM_SHRUNK = 3.0, 2.0
#: Words kept by a worker before its table starts anew.
MOST_WORDS = 100_000
#: Evidence against a text that is let pass, for low quality and for toxicity: one odd word alone doesn't take a clean text away.
CAUTION = (2.0, 0.2)
#: Raw components: text that the target leaves out, by its fault.
TARGET, LOW, TOXIC = 0, 1, 2


class Features(dict):
    """Words to rows of two tables: buckets of their single-word features and of their beginning, and a hash for pairs."""

    def __init__(self) -> None:
        self.buckets = array("i")
        self.hashes: list[int] = []

    def __missing__(self, word: str) -> int:
        core = word.strip(MARKS)
        tail = word[len(word.rstrip(MARKS)) :] if core else word
        shape = "U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "d" if core.isdigit() else "l"
        low = core.lower()
        found = self[word] = len(self.hashes)
        self.buckets.extend(xxhash.xxh3_64_intdigest(x) % WORD_BUCKETS for x in ("w" + low, "p" + tail, "s" + shape))
        # The last bucket is that of words too short, which say nothing.
        self.buckets.append(WORD_BUCKETS + PAIR_BUCKETS + (xxhash.xxh3_64_intdigest("b" + low[:STEM]) % (STEM_BUCKETS - 1) if len(low) >= STEM else STEM_BUCKETS - 1))
        self.hashes.append(xxhash.xxh3_64_intdigest(low))
        return found

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of known words (by 4), the texts' words among them, pair buckets (one for each word; -1 for the last of a text), and where texts begin."""
        if len(self) > MOST_WORDS:
            self.clear()
            self.__init__()
        words: list[str] = []
        starts = [0]
        for text in texts:
            words += text.split()
            starts.append(len(words))
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        known = np.array(self.buckets, np.int32).reshape(-1, 4)
        hashes = np.array(self.hashes, np.uint64)[rows]
        pairs = np.full(len(words), -1, np.int64)
        if len(words) > 1:
            left, right = hashes[:-1], hashes[1:]
            mixed = (left * np.uint64(0x9E3779B97F4A7C15) ^ right) * np.uint64(0xD1B54A32D192ED03)
            pairs[:-1] = np.where(left == right, 0, (mixed >> np.uint64(40)) % np.uint64(PAIR_BUCKETS - 4) + np.uint64(4)).astype(np.int64)
        ends = np.array(starts[1:]) - 1
        pairs[ends[ends >= 0]] = -1
        for longer in (1, 2, 3):  # a word said three, four, five times on end
            again = np.flatnonzero((pairs[1:] == longer - 1) & (pairs[:-1] == longer - 1)) + 1
            pairs[again] = longer
        return known, rows, pairs, np.array(starts)

    def present(self, texts: list[str]) -> np.ndarray:
        """Buckets that each text has, once a text: a word said a thousand times in one text says no more of its class than one."""
        known, rows, pairs, starts = self.read(texts)
        text = np.repeat(np.arange(len(texts)), np.diff(starts))
        has = pairs >= 0
        keys = np.concatenate([(text[:, None] * BUCKETS + known[rows]).reshape(-1), text[has] * BUCKETS + WORD_BUCKETS + pairs[has]])
        return np.unique(keys) % BUCKETS


#: Punctuation taken off a word's ends (fixed values).
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’…"


def sketch(text: str, n: int = 5, values: int = 4) -> tuple[int, ...]:
    """A few minimum hashes of word shingles: near copies have some in common."""
    words = text.split()
    hashes = np.array([xxhash.xxh3_64_intdigest(" ".join(words[i : i + n])) for i in range(max(1, len(words) - n + 1))], np.uint64)
    return tuple(int(((hashes * np.uint64(2 * i + 0x9E3779B97F4A7C15)) >> np.uint64(1)).min()) for i in range(values))


@dataclass
class Models:
    """Log ratio of the target's rate to each raw component's, by bucket, and the log odds of the labelled classes."""

    ratios: np.ndarray
    odds: tuple[float, float]

    def weights(self, features: Features, texts: list[str]) -> np.ndarray:
        """Log importance weight of each text: against the raw component that explains it better."""
        known, rows, pairs, starts = features.read(texts)
        out = np.empty((2, len(texts)))
        for c in range(2):
            ratio = self.ratios[c]
            each = ratio[known].sum(1)[rows]
            has = pairs >= 0
            each[has] += ratio[WORD_BUCKETS + pairs[has]]
            sums = np.concatenate([[0.0], np.cumsum(each)])
            out[c] = sums[starts[1:]] - sums[starts[:-1]] + self.odds[c]
        return out.min(0)


def fit(counts: np.ndarray, rows: list[int], drawn: float = DRAWN, shrunk: float = SHRUNK, certain: float = CERTAIN, caution: tuple[float, float] = CAUTION) -> Models:
    """Models of counts (classes by buckets) and of the number of rows of each class. A class without rows counts as no evidence."""
    counts = counts.astype(np.float64)
    out = []
    stems = WORD_BUCKETS + PAIR_BUCKETS
    counts[:, -1] = 0
    for part in (slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, stems), slice(stems, BUCKETS)):
        mine = counts[:, part]
        share = mine.sum(0) / max(mine.sum(), 1)
        expected = mine.sum(1)[:, None] * share[None, :]
        rate = np.log((mine + drawn) / (expected + drawn))
        ratio = rate[TARGET][None, :] - rate[[LOW, TOXIC]]
        odd = np.abs(mine - expected) / np.sqrt(expected + 1)
        least, off = certain, shrunk
        if part.start == stems:
            least, off = STEM_CERTAIN, STEM_SHRUNK * np.sqrt(1 / (mine[TARGET] + drawn) + 1 / (mine[[LOW, TOXIC]] + drawn))
        sure = np.maximum(odd[TARGET], odd[[LOW, TOXIC]]) >= least
        out.append(np.where(sure, np.sign(ratio) * np.maximum(0, np.abs(ratio) - off), 0))
    return Models(np.concatenate(out, 1).astype(np.float32), tuple(math.log((rows[TARGET] + 1) / (rows[c] + 1)) + pass_ for c, pass_ in zip((LOW, TOXIC), caution)))


def fit_models(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Models:
    """Count hashed n-grams of labelled texts by class: target (quality 1, not toxic), low quality, toxic."""
    spark = docs.sparkSession
    quality, toxic = F.coalesce(F.col("quality"), F.lit(1)), F.coalesce(F.col("toxic"), F.lit(0))
    kind = F.when(toxic == 1, TOXIC).when(quality == 0, LOW).otherwise(TARGET)
    chosen = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), kind.alias("_class")).distinct()
    chosen = chosen.orderBy(F.xxhash64("_id", "_class"), "_id", "_class").limit(fit_rows)  # at most fit_rows rows of two integers are broadcast
    text_batches(spark)
    texts = checkpointed(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id"))

    def sketches(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(sketch(t)) for t in batch.column(2).to_pylist()], pa.list_(pa.int64()))], names=["_id", "hash", "values"])

    # Of near copies one is counted, else the words of a text with many copies look like those of its class.
    kind = texts.schema["_id"].dataType.simpleString()
    seen = texts.select("_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(lean(sketches), f"_id {kind}, hash long, values array<long>")
    firsts = seen.select(F.struct("_id", "hash").alias("row"), F.posexplode("values").alias("i", "value")).groupBy("i", "value").agg(F.min("row").alias("row"))
    first = firsts.groupBy("row").count().where("count = 4").select("row._id", F.col("row.hash").alias("hash"))
    texts = texts.withColumn("hash", F.xxhash64("text")).join(F.broadcast(first), ["_id", "hash"], "left_semi")

    def run(batches):
        features, counts, rows = Features(), np.zeros((3, BUCKETS), np.int64), np.zeros(3, np.int64)
        for batch in batches:
            classes, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for c in range(3):
                mine = [t for t, k in zip(texts, classes) if k == c]
                rows[c] += len(mine)
                if mine:
                    counts[c] += np.bincount(features.present(mine), minlength=BUCKETS)
        for c in range(3):
            at = np.flatnonzero(counts[c])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, c, np.int32)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(counts[c][at], rows[c]))], names=["class", "bucket", "n"])

    sums = texts.select("_class", "text").mapInArrow(lean(run), "class int, bucket int, n long").groupBy("class", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts, rows = np.zeros((3, BUCKETS), np.int64), [0, 0, 0]
    classes, buckets, n = (sums.column(i).to_numpy() for i in range(3))
    inner = buckets >= 0
    counts[classes[inner], buckets[inner]] = n[inner]
    for c, k in zip(classes[~inner], n[~inner]):
        rows[c] = int(k)
    return fit(counts, rows)


def importance(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, seed: int = 23, temperature: float = 0.1) -> DataFrame:
    """Log weight of every whole text, and its key: the weight plus Gumbel noise from a hash of id and text."""
    spark = docs.sparkSession
    text_batches(spark)
    sent = spark.sparkContext.broadcast(models)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        features = Features()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            weights, at = [], 0
            while at < len(texts):  # some MB of text at a time
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) < 1_000_000):
                    size += len(texts[end])
                    end += 1
                weights.append(sent.value.weights(features, texts[at:end]))
                at = end
            weight = np.concatenate(weights) if weights else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(weight)], names=["key", "hash", "log_weight"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    scored = docs.select(F.col(id_col).alias("key"), text.alias("text"), F.xxhash64(text).alias("hash")).mapInArrow(lean(run), f"key {kind}, hash long, log_weight double")
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "key", "hash"), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return scored.withColumn("gumbel_key", F.col("log_weight") - F.lit(temperature) * F.log(-F.log(uniform)))


def top_threshold(keys: DataFrame, k: int, column: str) -> tuple[int, int]:
    """The k-th largest value of an integer column, and how many rows are above it.

    A histogram of 4096 bins is taken of the values that still may be it, and its one bin entered, until a bin is one value.
    """
    low, high = keys.agg(F.min(column), F.max(column)).first()
    above = 0
    while low < high:
        width = max(1, math.ceil((high - low + 1) / 4096))
        inside = keys.where((F.col(column) >= low) & (F.col(column) <= high))
        bins = inside.groupBy(F.floor((F.col(column) - low) / width).cast("int").alias("bin")).count().collect()
        for row in sorted(bins, key=lambda r: -r["bin"]):
            if above + row["count"] >= k:
                low, high = low + row["bin"] * width, min(high, low + (row["bin"] + 1) * width - 1)
                break
            above += row["count"]
    return low, above


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int | None = None, fit_rows: int = FIT_ROWS, temperature: float = 0.1, seed: int = 23) -> DataFrame:
    """Sample documents by importance, without replacement: the `size` largest of log weight plus Gumbel noise.

    Target and raw models are fitted on at most `fit_rows` labelled rows, the raw one by fault (low quality, toxic); a text's weight is the ratio
    against the fault that explains it better, with the labels' odds. Where `size` is not given, it is the number of texts that are more
    likely target than not, so that the sample leaves out what is not wanted and clean text stays. `temperature` scales the noise: 1 samples
    in proportion to weight, 0 takes the best.

    Returns a row for each document sampled: the id column, hash (of its text), log_weight, gumbel_key, kept (true). A null text counts as empty and
    weighs what the labels' odds say; null ids count; rows equal in id and text are decided together, so a sample may hold some rows more than
    `size` (equal keys aren't parted); an empty table or a size of 0 gives an empty one; with no labels every weight is 0 and all are as likely.
    """
    models = fit_models(docs, labels, fit_rows, id_col, text_col)
    scored = checkpointed(importance(docs, models, id_col, text_col, seed=seed, temperature=temperature).withColumn("order", F.floor(F.col("gumbel_key") * 1e9).cast("long")))
    rows = scored.count()
    k = scored.where("log_weight >= 0").count() if size is None else min(size, rows)
    if not k:
        scored = scored.where("false")
    elif k < rows:
        least, _ = top_threshold(scored, k, "order")
        scored = scored.where(F.col("order") >= least)
    return scored.select(F.col("key").alias(id_col), "hash", "log_weight", "gumbel_key", F.lit(True).alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of the sample, with the input's columns, whatever their names.

    Rows equal in id and text stay or go together, so repeated rows stay repeated; null ids count, a null text counts as empty; an empty table gives an
    empty one, and without labels all rows are as likely.
    """
    key, hash_, own = unused(docs.columns, "key", "hash", "text_hash")
    kept = resample(docs, labels, id_col, text_col, **how).select(F.col(id_col).alias(key), F.col("hash").alias(hash_)).distinct()
    marked = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return marked.join(kept, marked[id_col].eqNullSafe(kept[key]) & (marked[own] == kept[hash_]), "left_semi").drop(own)
