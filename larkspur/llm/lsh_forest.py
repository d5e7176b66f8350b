"""Near duplicates by an LSH forest: sorted signature orders, longest common prefixes, exact confirmation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, components, lean, text_batches, unused, with_links, written

#: Minimum hashes of a signature, trees (orders of the hashes), and the depths between which a tree's regions are cut.
HASHES, TREES, SHALLOW, DEEP = 160, 32, 4, 6
#: A region larger than this is entered one level deeper, while there is one.
REGION = 24
#: Rows of one key that a task holds at a time.
HELD = 400_000
#: Bits compared before a pair is confirmed, and how many must agree; a pair at similarity 0.8 agrees in 115.2 of them, standard deviation 3.4.
BITS, AGREE = 128, 97
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_rng = np.random.default_rng(20240229)
FACTORS = (_rng.integers(0, 1 << 31, HASHES, np.int64) * 2 + 1).astype(np.uint32)
SHIFTS = _rng.integers(0, 1 << 32, HASHES, np.int64).astype(np.uint32)
#: Orders of hashes, one for each tree: the forest's orders share hashes, no two in the same place.
ORDERS = np.concatenate([_rng.permutation(HASHES) for _ in range(-(-TREES * DEEP // HASHES))])[: TREES * DEEP].reshape(TREES, DEEP)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: str, n: int, words: WordHashes) -> np.ndarray:
    """Distinct hashes (64 bits, sorted) of runs of n words; a text with fewer words is one shingle, one without words none."""
    found = text.encode().translate(LOWER_BYTES).split()
    if not found:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    span = min(n, len(each))
    mixed = np.zeros(len(each) - span + 1, np.uint64)
    for k in range(span):
        mixed = (mixed ^ each[k : k + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed + np.uint64(span))  # a short text's one shingle is of another kind


def digest(sets: np.ndarray) -> tuple[int, int]:
    whole = xxhash.xxh3_128_digest(sets.tobytes())
    return int.from_bytes(whole[:8], "little", signed=True), int.from_bytes(whole[8:], "little", signed=True)


def signature(sets: np.ndarray) -> np.ndarray:
    low = (sets >> np.uint64(16)).astype(np.uint32)
    out = np.empty(HASHES, np.uint32)
    for at in range(0, HASHES, 16):
        part = slice(at, at + 16)
        out[part] = (low[None, :] * FACTORS[part, None] + SHIFTS[part, None]).min(1)
    return out


def similar(size_a: int, size_b: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (size_a + size_b - common)


def agreements(bits: np.ndarray, one: np.ndarray) -> np.ndarray:
    return BITS - np.bitwise_count(bits ^ one).sum(1).astype(np.int64)


def region_links(bits: np.ndarray, ids: np.ndarray, of: np.ndarray | None) -> list[tuple[int, int]]:
    """Pairs of a region to confirm; those whose bits agree too little are left out.

    Without components (of is None): each member with the one nearest to the region's majority, which for copies of one text is that text or
    like it, and each with its successor in the signature order. With components: the pairs of members of two components.
    """
    out = []
    if of is None:
        unpacked = np.unpackbits(bits.view(np.uint8), axis=1)
        common = np.packbits((2 * unpacked.sum(0) > len(bits)).astype(np.uint8)).view(np.uint64)
        near = agreements(bits, common)
        leader = int(np.lexsort((ids, -near))[0])
        for at in np.flatnonzero(agreements(bits, bits[leader]) >= AGREE):
            if at != leader:
                out.append((leader, int(at)))
        beside = BITS - np.bitwise_count(bits[1:] ^ bits[:-1]).sum(1).astype(np.int64)
        out += [(int(at), int(at) + 1) for at in np.flatnonzero(beside >= AGREE)]
    else:
        names, sizes = np.unique(of, return_counts=True)
        largest = names[np.argmax(sizes)]
        for at in np.flatnonzero(of != largest):  # pairs inside the largest component never come up
            agree = agreements(bits, bits[at])
            other = np.flatnonzero((of != of[at]) & (agree >= AGREE))
            out += [(int(at), int(x)) for x in other]
    return [(min(int(ids[a]), int(ids[b])), max(int(ids[a]), int(ids[b]))) for a, b in out if ids[a] != ids[b]]


def regions(key: np.ndarray, deeper: np.ndarray):
    """Bounds of the regions of one order, sorted: equal keys, and where too many, equal deeper values one by one."""
    cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
    for first, last in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])):
        todo = [(int(first), int(last), 0)]
        while todo:
            a, b, level = todo.pop()
            if b - a < 2:
                continue
            if b - a <= REGION or level == deeper.shape[1]:
                yield a, b
                continue
            inner = np.flatnonzero(deeper[a + 1 : b, level] != deeper[a : b - 1, level]) + a + 1
            todo += [(int(x), int(y), level + 1) for x, y in zip(np.concatenate([[a], inner]), np.concatenate([inner, [b]]))]


def sketched(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """For each row its id and a hash of its text, the size and 128-bit digest of its set, and the set's signature."""
    text_batches(docs.sparkSession)

    def run(batches):
        words = WordHashes()
        for batch in batches:
            sizes, one, two, signs = [], [], [], []
            for text in batch.column(2).to_pylist():
                sets = shingles(text or "", n, words)
                sizes.append(len(sets))
                for half, value in zip((one, two), digest(sets)):
                    half.append(value)
                signs.append(signature(sets).tobytes() if len(sets) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(signs, pa.binary())], names=["id", "hash", "size", "one", "two", "signature"])

    given = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("hash"), F.col(text_col).alias("text"))
    return given.mapInArrow(lean(run), "id long, hash long, size long, one long, two long, signature binary")


def text_hash(text_col: str):
    """With the id, what tells a row from rows of other texts."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def forest_rows(classes: DataFrame) -> DataFrame:
    """A row for each class and tree: the prefix's key at the shallow depth, deeper values, the bits to compare, and the component so far."""

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(m, HASHES)
            bits = np.packbits((signs[:, :BITS] >> 7 & 1).astype(np.uint8), axis=1).view(np.int64)
            values = signs[:, ORDERS.reshape(-1)].reshape(m, TREES, DEEP).transpose(1, 0, 2).reshape(-1, DEEP)
            key = np.repeat(np.arange(TREES, dtype=np.uint64), m)
            for d in range(SHALLOW):
                key = (key ^ values[:, d]) * np.uint64(0xD1B54A32D192ED03)
                key ^= key >> np.uint64(29)
            columns = [key.view(np.int64), *(np.ascontiguousarray(values[:, d]).view(np.int32) for d in range(SHALLOW, DEEP)), np.tile(batch.column(0).to_numpy(), TREES), *(np.tile(bits[:, i], TREES) for i in range(BITS // 64)), np.tile(batch.column(2).to_numpy(), TREES)]
            for at in range(0, len(key), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 8192]) for c in columns], names=FOREST)

    schema = ", ".join(f"{c} {'int' if c[0] == 'd' else 'long'}" for c in FOREST)
    return classes.select("id", "signature", F.col("component").cast("long")).mapInArrow(lean(run), schema)


LEVELS = [f"d{d}" for d in range(DEEP - SHALLOW)]
LANES = [f"b{i}" for i in range(BITS // 64)]
FOREST = ["key", *LEVELS, "id", *LANES, "component"]


def candidates(forest: DataFrame, with_components: bool) -> DataFrame:
    """Pairs (a, b) to confirm, from the regions of every order."""
    ordered = (forest if with_components else forest.drop("component")).repartition("key").sortWithinPartitions("key", *LEVELS, "id")

    def run(batches):
        held = None

        def links(table: pa.Table):
            column = {c: table.column(c).to_numpy() for c in table.column_names}
            key = column["key"]
            # Only keys that come more than once have regions.
            same = np.zeros(len(key), bool)
            same[1:] |= key[1:] == key[:-1]
            same[:-1] |= key[1:] == key[:-1]
            at = np.flatnonzero(same)
            if not len(at):
                return
            bits = np.stack([column[c][at] for c in LANES], 1).view(np.uint64)
            key, ids = key[at], column["id"][at]
            deeper = np.stack([column[c][at] for c in LEVELS], 1)
            of = column["component"][at] if with_components else None
            found: list[tuple[int, int]] = []
            for a, b in regions(key, deeper):
                mine = None if of is None else of[a:b]
                if mine is not None and (mine == mine[0]).all():
                    continue
                found += region_links(bits[a:b], ids[a:b], mine)
            pairs = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows < min(50_000, HELD):
                continue
            key = held.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on
            if cut:
                yield from links(held.slice(0, cut))
                held = held.slice(cut).combine_chunks()
            elif held.num_rows >= HELD:  # a key without end goes on from its last row: its stretches are one family, compared block by block later
                yield from links(held)
                held = held.slice(held.num_rows - 1).combine_chunks()
        if held is not None and held.num_rows:
            yield from links(held)

    return ordered.mapInArrow(lean(run), "a long, b long").distinct()


def sets_of(classes: DataFrame, docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(id, set) of classes (id, doc, two), made again from the text of a document `doc` that bears it: only of those that stand in a pair, and once."""

    def run(batches):
        words = WordHashes()
        for batch in batches:
            ids, sets = [], []
            for text, one, two in zip(*(c.to_pylist() for c in batch.columns)):
                made = shingles(text or "", n, words)
                if digest(made) == (one, two):
                    ids.append(one)
                    sets.append(made.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["id", "set"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    wanted = classes.select(F.col("doc").alias("id"), F.col("id").alias("one"), "two")
    return texts.join(wanted, "id").select("text", "one", "two").mapInArrow(lean(run), "id long, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes whose full sets are similar."""

    def check(batches):
        for batch in batches:
            a, b, one, two = (batch.column(i) for i in range(4))
            keep = []
            for x, y in zip(one.to_pylist(), two.to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")  # two sorted runs: a merge
                keep.append(similar(len(x), len(y), int((both[1:] == both[:-1]).sum()), percent))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(lean(check), "a long, b long")


#: Members of a family that are compared together: those outside its largest component, by those of the whole family.
OUTSIDE, ALL = 512, 2048


def block_links(ids: np.ndarray, of: np.ndarray, outside: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between different components of a block: each outside member's shared shingles with all others, counted from an index of shingles."""
    sizes = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    _, where = np.unique(np.concatenate(sets), return_inverse=True)
    counts = np.bincount(where)
    begins = np.concatenate([[0], np.cumsum(counts)])[:-1]
    bearers = row[np.argsort(where, kind="stable")]
    ends = np.cumsum(sizes)
    out = []
    for x in np.flatnonzero(outside):
        mine = where[ends[x] - sizes[x] : ends[x]]
        mine = mine[counts[mine] > 1]
        many = counts[mine]
        at = np.repeat(begins[mine] - np.cumsum(many) + many, many) + np.arange(many.sum())
        common = np.bincount(bearers[at], minlength=len(sets))
        hit = (100 * common >= percent * (sizes + sizes[x] - common)) & (of != of[x])
        for y in np.flatnonzero(hit):
            out.append((min(int(ids[x]), int(ids[y])), max(int(ids[x]), int(ids[y]))))
    return out


def family_links(families: DataFrame, named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components within a family: classes that candidate pairs connect, confirmed or not.

    Members outside a family's largest component meet all its members, block by block, and only links come out: a large family of
    near misses costs comparisons, but no pairs are made.
    """
    members = families.withColumnRenamed("component", "family").join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = members.groupBy("family", "component").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("all"), F.max("n").alias("most"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n, size: F.ceil(n / size).cast("int")
    plan = whole.select("family", "largest", blocks(F.col("all") - F.col("most"), OUTSIDE).alias("xs"), blocks(F.col("all"), ALL).alias("ys"))
    rows = checkpointed(members.join(plan, "family").select("id", "family", "component", (F.col("component") != F.col("largest")).alias("outside"), "xs", "ys"))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    x = rows.where("outside").select("id", "family", "component", "outside", mine("xs").alias("x"), F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("y"))
    y = rows.select("id", "family", "component", F.lit(False).alias("outside"), F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("x"), mine("ys").alias("y"))
    met = x.unionByName(y).join(sets, "id")

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key = block_keys(held)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            if len(cut):
                yield linked(held.slice(0, int(cut[-1])))
                held = held.slice(int(cut[-1])).combine_chunks()
        if held is not None and held.num_rows:
            yield linked(held)

    def block_keys(table: pa.Table) -> np.ndarray:
        return np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("family", "x", "y")], 1)

    def linked(table: pa.Table) -> pa.RecordBatch:
        key = block_keys(table)
        cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]])
        ids, of, outside = (table.column(c).to_numpy() for c in ("id", "component", "outside"))
        raw, out = table.column("set"), set()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if outside[a:b].any():
                out |= set(block_links(ids[a:b], of[a:b], outside[a:b], [np.frombuffer(s, np.uint64) for s in raw[a:b].to_pylist()], percent))
        pairs = np.array(sorted(out), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    ordered = met.select("family", "x", "y", "id", "component", "outside", "set").repartition("family", "x", "y").sortWithinPartitions("family", "x", "y")
    return ordered.mapInArrow(lean(run), "a long, b long").distinct()


def classes_met(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    met = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    return ids.join(met, "id", "left_semi")


def with_component(classes: DataFrame, pairs: DataFrame, named: DataFrame) -> DataFrame:
    """Classes that stood in a pair, each with its component so far: its own id if it was linked with none."""
    return classes_met(classes.select("id", "signature"), pairs).join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))


def classed(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each input row: id, hash (of the text), size, label of its class (null: an empty set) and component (the smallest id of its class).

    Classes stand for sets, not for ids: half of a set's digest is its number, and `doc` is the smallest id that bears it. So rows that give one id different
    texts stand for themselves, each in the class of its own text.
    """
    rows = written(sketched(docs, id_col, text_col, n))
    full = rows.where("id is not null and size > 0")
    bearers = full.groupBy("one", "two", "id").agg(F.count("*").alias("rows"))
    ids = checkpointed(bearers.groupBy("one", "two").agg(F.min(F.struct("id", "rows")).alias("d")).select(F.col("one").alias("id"), "two", F.col("d.id").alias("doc"), (F.col("d.rows") > 1).alias("again")))

    def once(of: Callable[[DataFrame], DataFrame], some: DataFrame) -> DataFrame:
        """A row for each class; only those whose row is repeated are shuffled to be told apart."""
        return of(some.where("not again")).unionByName(of(some.where("again")).dropDuplicates(["id"]))

    def signed(some: DataFrame) -> DataFrame:
        of_doc = some.select(F.col("doc").alias("id"), F.col("id").alias("one"), "two")
        return full.join(of_doc, ["id", "one", "two"], "left_semi").select(F.col("one").alias("id"), "signature")

    classes = once(signed, ids)
    tried = checkpointed(candidates(forest_rows(classes.withColumn("component", F.lit(0))), False))
    held = written(once(lambda some: sets_of(some, docs, n, id_col, text_col), checkpointed(classes_met(ids, tried))))
    sure = checkpointed(confirmed(tried, held, percent))
    named = components(sure)
    # What is left to compare: pairs across families one by one, those within a family block by block.
    families = checkpointed(with_links(named, tried))
    apart = candidates(forest_rows(with_component(classes, tried, families)), True)
    more = checkpointed(confirmed(apart, held, percent).union(family_links(families, named, held, percent)))
    named = with_links(named, more)
    labels = checkpointed(ids.join(named, "id", "left").select(F.col("id").alias("one"), "two", "doc", F.coalesce("component", "id").alias("label")))
    smallest = labels.groupBy("label").agg(F.min("doc").alias("component"))
    of_set = labels.join(smallest, "label").select("one", "two", "label", "component")
    joined = rows.join(of_set, ["one", "two"], "left")
    mine = F.col("id").isNotNull() & (F.col("size") > 0)
    return joined.select("id", "hash", "size", F.when(mine, F.col("label")).alias("label"), F.when(mine, F.col("component")).otherwise(F.col("id")).alias("component"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents linked by similar sets of word shingles.

    Words are split at white space, A-Z in lower case; a set holds the distinct runs of n words (a shorter text is one run). Texts are linked if
    100 times the shared shingles are at least `percent` times all. Rows of equal sets form one class at once; classes are compared
    through a forest of sorted signature orders, and a link counts when the full sets confirm it. First every member of a
    region is compared with the member nearest to its majority and with its neighbour in the order. What these pairs connect is a family; then members
    outside a family's largest component are compared with the whole family, in blocks that give out links alone, and pairs of a region that lie
    in two families one by one. So a region of copies of one text costs two pairs a member, and no pair of a region that could join components is
    passed over.
    A pair at exactly 0.8 is missed by all orders with a chance of about 6e-5 in the deepest regions and 1e-7 in the others.

    Returns one row for each input row: the id column, n_shingles, component_id (the smallest id reachable), kept (id = component_id).
    A null or wordless text has an empty set and is linked with nothing; ids are integers; rows of a null id stay alone, with a null component_id
    and kept null, as nothing can be said of them; repeated rows are kept and fall into one class; rows that give one id different texts fall each into the class of
    its own text; an empty table gives an empty one; other columns are not looked at.
    """
    rows = classed(docs, n, percent, id_col, text_col)
    return rows.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with the input's columns, whatever their names: that of the smallest id, and of the smallest text hash among rows of that id.

    Of rows equal in id and text one stays. A text without words is a class of its own with its id. Rows of a null id all stay. An empty table gives an empty one.
    """
    id_, hash_, own = unused(docs.columns, "id_of", "hash_of", "text_hash")
    rows = classed(docs, n, percent, id_col, text_col).where("id is not null")
    first = rows.where("id = component and label is not null").groupBy("label").agg(F.min(F.struct("id", "hash")).alias("stays"))
    told = rows.join(first, "label", "left")
    gone = told.where("label is not null and struct(id, hash) <> stays").select(F.col("id").alias(id_), F.col("hash").alias(hash_)).distinct()
    marked = docs.withColumn(own, text_hash(text_col))
    left = marked.join(gone, (marked[id_col].cast("long") == gone[id_]) & (marked[own] == gone[hash_]), "left_anti")
    once = left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, own])
    return once.unionByName(left.where(F.col(id_col).isNull())).drop(own)
