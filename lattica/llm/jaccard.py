"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

Two texts link when the Jaccard similarity of their sets of word shingles is at
least 3/4, that is when sets of a and b elements share c(a, b) = ceil(3(a+b)/7).

* Equal sets are one class; only classes are compared.
* Light sets, up to a boundary chosen by cost, enumerate their subsets of
  c(a, b) elements for each size b they could link with.  An equal subset proves
  a link, so a group of equal subsets needs links to its smallest class only.
* Heavy sets are looked up in inverted lists.  Elements are ordered by a counting
  sketch of all texts, rare ones first, and a list holds the sets that have its
  element among their first size - c + 1; every link meets in the list of its
  first common element.  Sizes and positions discard most pairs in the join.

All postings take one shuffle, which makes a list one row; lists that may be long
stay rows of single sets, like subsets, and are paired by joins.

Lists of many near copies would make pairs in the square of their length.  Only
components are asked for, so each list compares its sets with `PIVOTS` of its
own, chosen by hash, in several turns; sets that end up in one component need no
comparison any more, and what is left over between components is compared in
full.  Bits that count elements modulo two bound the difference of two sets and
spare most pairs that do not link; every link is checked on whole sets, and no
pair that could join two components is left out.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import append_columns, few, free_name, stored, stored_alone, texts_of
from lattica.llm.components import components
from lattica.llm.shingles import Hasher, mix

SKETCH = 1 << 23  # counters of the sketch that orders elements; it never decides a result
CHUNK = 1 << 16  # counters per row while sketches are added up
LIGHT = 10  # largest boundary that is considered
VERIFY = 4  # cost of checking a heavy set, in rows of a list
PIVOTS = 8
SETS_PER_TASK = 10_000  # while pairs are checked
TURNS = 6  # of pivots for long lists, at most; what they leave is compared in full
WORDS = 16  # numbers of 64 bits that hold the parities of a set
LONG_LIST = 5_000  # lists of elements estimated more frequent are not gathered in a row
FULL = 255  # largest count that a task tells of an element
FILTER_BITS = 1 << 24  # of the filter that keeps sets of no candidate out of the shuffle
FILTER_ROWS = 1_000_000  # whose bits one task puts together, each 200,000 in 2 MB at most


def common(a: int, b: int) -> int:
    """Elements that sets of a and b elements share at least if they link."""
    return -(-3 * (a + b) // 7)


def partners(a: int, largest: int) -> range:
    """Sizes up to `largest` that a set of a elements could link with."""
    return range(-(-3 * a // 4), min(4 * a // 3, largest) + 1)


@lru_cache
def subsets_of(a: int, largest: int) -> int:
    """Subsets that a light set of a elements enumerates."""
    return sum(comb(a, common(a, b)) for b in partners(a, largest))


def boundary(histogram: dict[int, int]) -> int:
    """Largest light size of least cost: rows of subsets against rows of lists and checks."""

    def cost(x: int) -> int:
        light = sum(n * subsets_of(s, x) for s, n in histogram.items() if s <= x)
        heavy = sum(n * (s // 4 + 1 + VERIFY) for s, n in histogram.items() if 4 * s >= 3 * (x + 1))
        return light + heavy

    return min(range(LIGHT + 1), key=cost)


def _class_of(elements: np.ndarray) -> int:
    return int.from_bytes(blake2b(elements.tobytes(), digest_size=8).digest(), "little", signed=True)


def _parities(elements: np.ndarray) -> np.ndarray:
    """One bit for each of 64 * WORDS cells: whether an odd number of elements falls into it.

    Two sets differ in at least as many elements as their bits differ.
    """
    cells = np.bincount((elements >> np.uint64(40)) % np.uint64(64 * WORDS), minlength=64 * WORDS) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Counters, most of them zero or small, in about a bit and a half each at most."""
    squeeze = zlib.compressobj(1, strategy=zlib.Z_RLE)
    return squeeze.compress(counts.tobytes()) + squeeze.flush()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8)


def _first_pass(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document (class, size and parities of its set), and rows of sketch counters."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([source.schema["id"], T.StructField("class", T.LongType()), T.StructField("size", T.IntegerType()),
                           T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("chunk", T.IntegerType()), T.StructField("counts", T.BinaryType())])

    def run(batches):
        hasher, sketch, seen, kind = Hasher(), np.zeros(SKETCH, np.uint32), set(), None
        for batch in batches:
            kind = batch.schema.field("id").type
            classes, sizes, bits = [], [], []
            for elements in hasher.sets(texts_of(batch.column("text"))):
                key = _class_of(elements)
                classes.append(key)
                sizes.append(len(elements))
                bits.append(_parities(elements))
                if key not in seen:  # copies within a task are counted once
                    seen.add(key)
                    np.add.at(sketch, (elements & np.uint64(SKETCH - 1)).astype(np.int64), np.uint32(1))
            n = len(classes)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(classes, pa.int64()), pa.array(sizes, pa.int32()),
                                              pa.array(bits, pa.list_(pa.int64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=schema.names)
        if kind is None:
            return
        small = np.minimum(sketch, FULL).astype(np.uint8)
        for chunk in range(SKETCH // CHUNK):
            counts = _packed(small[chunk * CHUNK : (chunk + 1) * CHUNK])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()),
                                              pa.nulls(1, pa.list_(pa.int64())), pa.array([chunk], pa.int32()), pa.array([counts], pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


def _level(counts: np.ndarray) -> np.ndarray:
    return np.round(8 * np.log2(1 + counts)).astype(np.uint8)


@dataclass(frozen=True)
class Order:
    """Order of elements: by level of the sketch, then by hash."""

    levels: np.ndarray  # one byte per counter
    hot: int  # level from which lists may be long

    def prefix(self, elements: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first n elements and whether the list of each may be long."""
        levels = self.levels[(elements & np.uint64(SKETCH - 1)).astype(np.int64)]
        first = np.lexsort((elements, levels))[:n]
        return elements[first], levels[first] >= self.hot


def _order(rows: DataFrame) -> Order:
    """Order by the sum of the sketches: SKETCH bytes, whatever the input."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                small = _unpacked(counts)  # a count that may be larger is taken for one of a long list
                sums[chunk] = sums.get(chunk, 0) + np.where(small == FULL, 2 * LONG_LIST, small.astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([_level(x).tobytes() for x in sums.values()], pa.binary()), pa.array([int(x.sum()) for x in sums.values()], pa.int64())],
            names=["chunk", "levels", "total"],
        )

    parts = rows.where("chunk IS NOT NULL").select("chunk", "counts")
    levels, total = np.zeros(SKETCH, np.uint8), 0
    for r in parts.repartition("chunk").mapInArrow(add, "chunk int, levels binary, total long").collect():
        levels[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.levels, np.uint8)
        total += r.total
    return Order(levels, int(_level(np.array(total / SKETCH + LONG_LIST))))


def _postings(docs: DataFrame, text_col: str, order: Order, x: int) -> DataFrame:
    """Rows of inverted lists (`kind` 0) and of enumerated subsets (`kind` 1).

    `meta` is the size of the set times 2^32, plus the element's position or, for
    subsets, the sizes the subset stands for.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        order, hasher, seen = shared.value, Hasher(), set()
        for batch in batches:
            tokens, keys, metas, hots, kinds = [], [], [], [], []

            def emit(token, key, meta, hot, kind):
                tokens.append(token)
                keys.append(np.full(len(token), key, np.int64))
                metas.append(meta)
                hots.append(hot)
                kinds.append(np.full(len(token), kind, np.int8))

            for elements in hasher.sets(texts_of(batch.column("text"))):
                size, key = len(elements), _class_of(elements)
                if not size or key in seen:
                    continue
                seen.add(key)
                if 4 * size >= 3 * (x + 1):
                    token, hot = order.prefix(elements, size // 4 + 1)
                    emit(token, key, (size << 32) + np.arange(len(token), dtype=np.int64), hot, 0)
                if size <= x:
                    for b in partners(size, x):
                        low, high = sorted((size, b))
                        chosen = np.array(list(combinations(elements.tolist(), common(size, b))), np.uint64)
                        token = mix(chosen.sum(1, dtype=np.uint64) + np.uint64(low << 8 | high))
                        emit(token, key, np.full(len(token), (size << 32) + (low << 8 | high), np.int64), np.zeros(len(token), bool), 1)
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(metas)),
                     pa.array(np.concatenate(hots)), pa.array(np.concatenate(kinds))],
                    names=["token", "class", "meta", "hot", "kind"],
                )

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "token long, class long, meta long, hot boolean, kind byte")


def _some(df: DataFrame, rows: int | None, per_task: int = 200_000) -> DataFrame:
    """`few` of a table whose rows, or a bound of them, are known: a task costs the driver memory, with rows or without."""
    return df if rows is None else few(df, rows, per_task)


def _shared_lists(postings: DataFrame) -> DataFrame:
    """Lists that hold at least two classes: `token`, `kind`, `hot` and `members`, each class and its meta once.

    A list is one row, made by the one shuffle that all postings take.  A list
    that may be long is `hot`: its classes are dealt out each for itself, and a
    row holds one of them.  So does a row of subsets, which any number may share.
    """
    place = F.when(F.col("hot"), F.xxhash64("token", "class")).otherwise(F.col("token"))
    dealt = postings.repartition(place).withColumn("place", place)
    whole = Window.partitionBy("place", "token", "kind", "hot")
    dealt = dealt.withColumn("low", F.min("class").over(whole)).withColumn("high", F.max("class").over(whole)).where("hot OR low <> high")
    alone = F.when(F.col("hot") | (F.col("kind") == 1), F.col("class")).alias("alone")
    lists = dealt.groupBy("place", "token", "kind", "hot", alone).agg(F.collect_set(F.struct("class", "meta")).alias("members"))
    return stored_alone(lists.drop("place", "alone"))


def _members(lists: DataFrame) -> DataFrame:
    """One row for each class of a list: `token`, `class`, `meta`."""
    return lists.select("token", F.inline("members"))


def _light_links(shared: DataFrame) -> DataFrame:
    """Links proved by equal subsets: from each class to the smallest of its group."""
    rows = _members(shared.where("kind = 1")).select("token", "class", (F.col("meta").bitwiseAND(0xFFFF)).alias("sizes"), F.shiftright("meta", 32).alias("size"))
    groups = rows.groupBy("token", "sizes").agg(F.min("class").alias("first"), F.min("size").alias("low"), F.max("size").alias("high"))
    # A subset for two sizes proves nothing about sets of one of them alone.
    groups = groups.where("low <> high OR sizes div 256 = sizes % 256").select("token", "sizes", "first")
    return rows.join(groups, ["token", "sizes"]).where("class <> first").select(F.col("first").alias("a"), F.col("class").alias("b"))


def _passes(left: Column, left_meta: Column, right: Column, right_meta: Column) -> Column:
    """Whether sizes and positions of a common element allow a link."""
    a, i = F.shiftright(left_meta, 32), left_meta.bitwiseAND(0xFFFFFFFF)
    b, j = F.shiftright(right_meta, 32), right_meta.bitwiseAND(0xFFFFFFFF)
    least = F.floor((3 * (a + b) + 6) / 7)
    return (4 * a >= 3 * b) & (4 * b >= 3 * a) & (i <= a - least) & (j <= b - least)


def _difference(left: list[Column], right: list[Column]) -> Column:
    """Bits in which parities differ."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(left, right)), F.lit(0))


def _near(a: Column, b: Column, difference: Column) -> Column:
    """Whether sets of sizes a and b may link if they differ in `difference` elements at least."""
    return difference <= a + b - 2 * F.floor((3 * (a + b) + 6) / 7)


def _pivots(lists: DataFrame, turn: int) -> DataFrame:
    """The first sets of each list by a hash that all lists share."""
    best = Window.partitionBy("token").orderBy(F.xxhash64("class", F.lit(turn)), "class")
    return lists.withColumn("place", F.row_number().over(best)).where(F.col("place") <= PIVOTS).drop("place")


def _by_pivots(lists: DataFrame, turn: int, rows: int | None = None) -> DataFrame:
    """Distinct pairs `a`, `b` of a pivot and another set of its list that pass the filters, at most `rows` if told.

    Lists with a column `root` pair only sets of different components.
    """
    rooted = "root" in lists.columns
    other = _pivots(lists, turn).select(F.col("token").alias("t"), F.col("class").alias("c"), F.col("meta").alias("m"), *[F.col("root").alias("r")] * rooted)
    apart = F.col("root") != F.col("r") if rooted else F.col("class") != F.col("c")
    pairs = lists.join(other, (F.col("token") == F.col("t")) & apart & _passes(F.col("class"), F.col("meta"), F.col("c"), F.col("m")))
    pairs = pairs.select(F.least("class", "c").alias("a"), F.greatest("class", "c").alias("b"))
    return _some(_some(pairs, rows).distinct(), rows)


def _within(lists: DataFrame, turn: int) -> DataFrame:
    """What `_by_pivots` finds, of lists that are one row each, where the rows lie."""
    ordered = F.array_sort(F.transform("members", lambda m: F.struct(F.xxhash64(m["class"], F.lit(turn)).alias("h"), m["class"].alias("class"), m["meta"].alias("meta"))))
    pivots = lists.select(ordered.alias("all")).select("all", F.explode(F.slice("all", 1, PIVOTS)).alias("p"))
    pairs = pivots.select("p", F.explode("all").alias("m")).where((F.col("p.class") != F.col("m.class")) & _passes(F.col("m.class"), F.col("m.meta"), F.col("p.class"), F.col("p.meta")))
    return pairs.select(F.least("m.class", "p.class").alias("a"), F.greatest("m.class", "p.class").alias("b")).distinct()


def _filtered(pairs: DataFrame, bits: DataFrame, rows: int | None = None) -> DataFrame:
    """Pairs, at most `rows` if told, whose parities allow a link."""
    left = bits.select(F.col("class").alias("a"), F.col("size").alias("n"), F.col("bits").alias("x"))
    right = bits.select(F.col("class").alias("b"), F.col("size").alias("m"), F.col("bits").alias("y"))
    both = _some(_some(pairs.join(left, "a"), rows).join(right, "b"), rows)
    difference = _difference([F.col("x")[k] for k in range(WORDS)], [F.col("y")[k] for k in range(WORDS)])
    return both.where(_near(F.col("n"), F.col("m"), difference)).select(*pairs.columns)


def _all_pairs(lists: DataFrame, bits: DataFrame, rows: int | None = None) -> DataFrame:
    """All distinct pairs of sets of different components that share one of the lists, of `rows` rows, and pass the filters."""
    known = _some(lists.join(bits.select("class", *[F.col("bits")[k].alias(f"x{k}") for k in range(WORDS)]), "class"), rows)
    other = known.select(F.col("token").alias("t"), F.col("class").alias("c"), F.col("meta").alias("m"), F.col("root").alias("r"),
                         *[F.col(f"x{k}").alias(f"y{k}") for k in range(WORDS)])
    difference = _difference([F.col(f"x{k}") for k in range(WORDS)], [F.col(f"y{k}") for k in range(WORDS)])
    near = _near(F.shiftright("meta", 32), F.shiftright("m", 32), difference)
    apart = (F.col("token") == F.col("t")) & (F.col("root") != F.col("r")) & (F.col("class") < F.col("c"))
    pairs = known.join(other, apart & _passes(F.col("class"), F.col("meta"), F.col("c"), F.col("m")) & near)
    return pairs.select(F.col("class").alias("a"), F.col("c").alias("b")).distinct()


def _with_roots(lists: DataFrame, roots: DataFrame, rows: int | None = None) -> DataFrame:
    """Lists, of `rows` rows, with the component of each set, without lists that lie in one component."""
    known = _some(lists.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class")), rows)
    mixed = known.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    return _some(known.join(mixed, "token", "left_semi"), rows)


def _filter_of(classes: DataFrame, rows: int | None = None) -> np.ndarray:
    """FILTER_BITS bits that are set for the classes of the column `class`, of `rows` rows, and few others."""
    bit = F.pmod(F.col("class"), F.lit(FILTER_BITS)) + 1  # bitmaps number their bits from 1
    buckets = (
        _some(classes.select(bit.alias("bit")).distinct(), rows).groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    )
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in _some(buckets, rows, FILTER_ROWS).collect():  # buckets of 32768 bits, numbered from 1
        bits[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return bits


def _holds(bits: np.ndarray, classes: np.ndarray) -> np.ndarray:
    place = classes % FILTER_BITS
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _wanted_sets(docs: DataFrame, text_col: str, classes: DataFrame, rows: int | None = None) -> DataFrame:
    """Sets of (about) the given classes, at most `rows` if told: `key`, `class`, `elements`; a filter keeps most others from being written.

    Tasks may write the same class; its smallest key names the one that is used,
    so that no set is shuffled to find copies.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(classes, rows))

    def run(batches):
        hasher, seen = Hasher(), set()
        for batch in batches:
            sets = list(hasher.sets(texts_of(batch.column("text"))))
            keys = np.array([_class_of(s) for s in sets], np.int64)
            chosen = []
            for i in np.flatnonzero(_holds(shared.value, keys)).tolist():
                key = int(keys[i])
                if len(sets[i]) and key not in seen:
                    seen.add(key)
                    chosen.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(keys[chosen]), pa.array([sets[i].tobytes() for i in chosen], pa.binary())], names=["class", "elements"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "class long, elements binary")
    return stored(found.select(F.xxhash64("class", F.monotonically_increasing_id()).alias("key"), "class", "elements"))


def _some_sets(sets: DataFrame, pairs: DataFrame, rows: int) -> DataFrame:
    """(About) the sets that the pairs, of `rows` rows, name, so that no other is shuffled."""
    shared = sets.sparkSession.sparkContext.broadcast(_filter_of(pairs.select(F.explode(F.array("left", "right")).alias("class")), 2 * rows))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_holds(shared.value, batch.column("key").to_numpy())))

    return sets.mapInArrow(run, sets.schema)


def _verified(pairs: DataFrame, sets: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs, at most `most` if told, whose whole sets link."""
    keys = sets.groupBy("class").agg(F.min("key").alias("key"))
    pairs = _some(pairs.join(keys.select(F.col("class").alias("a"), F.col("key").alias("left")), "a"), most)
    pairs = stored(_some(pairs.join(keys.select(F.col("class").alias("b"), F.col("key").alias("right")), "b"), most))
    rows = pairs.count()
    pairs, sets = few(pairs, rows), few(_some_sets(sets, pairs, rows), 2 * rows, SETS_PER_TASK)
    left = sets.select(F.col("key").alias("left"), F.col("elements").alias("x"))
    right = sets.select(F.col("key").alias("right"), F.col("elements").alias("y"))

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(100 * both >= 75 * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    both = few(few(pairs.join(left, "left"), rows, SETS_PER_TASK).join(right, "right"), rows, SETS_PER_TASK)
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def classes_and_roots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(`id`, `class`, `size`) of every row, and (`class`, `root`) of every linked class."""
    first = stored(_first_pass(docs, id_col, text_col))
    rows = first.where("chunk IS NULL").select("id", "class", "size")
    small = rows.where(F.col("size").between(1, 2 * LIGHT)).groupBy("class").agg(F.first("size").alias("size")).groupBy("size").count().collect()
    x = boundary({r["size"]: r["count"] for r in small})
    order = _order(first)
    shared = _shared_lists(_postings(docs, text_col, order, x))
    lists, hot = shared.where("kind = 0 AND NOT hot"), _members(shared.where("kind = 0 AND hot"))
    bits = first.where("size > 0").dropDuplicates(["class"]).select("class", "size", "bits")
    pairs = stored_alone(_filtered(_within(lists, 1).union(_by_pivots(hot, 1)).distinct(), bits))
    # Lists of up to PIVOTS + 1 sets are now paired in full.
    long = hot.groupBy("token").count().where(F.col("count") > PIVOTS + 1).select("token")
    rest = stored_alone(_members(lists.where(F.size("members") > PIVOTS + 1)).union(hot.join(long, "token", "left_semi")))
    n, n_pairs = rest.count(), pairs.count()
    rest = few(rest, n)
    some = rest.select("class").distinct()
    bits = stored_alone(bits.join(some, "class", "left_semi"))
    sets = _wanted_sets(docs, text_col, pairs.select(F.explode(F.array("a", "b")).alias("class")).union(some), 2 * n_pairs + n)

    def joined(roots: DataFrame | None, more: DataFrame) -> DataFrame:
        if roots is None:
            return stored(components(more))
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        return stored(components(more.union(known), rows=more.count() + roots.count()))

    def apart(lists: DataFrame, n: int, roots: DataFrame) -> tuple[DataFrame, int]:
        left = stored(_with_roots(lists.select("token", "class", "meta"), roots, n))
        n = left.count()
        return few(left, n), n

    roots = joined(None, _light_links(shared).union(stored_alone(_verified(pairs, sets, n_pairs))))
    for turn in range(2, TURNS + 1):
        rest, n = apart(rest, n, roots)
        most = PIVOTS * n
        more = stored_alone(_verified(_filtered(_by_pivots(rest, turn, most), bits, most), sets, most))
        if more.isEmpty():
            break
        roots = joined(roots, more)
    else:
        rest, n = apart(rest, n, roots)
    more = stored_alone(_verified(_all_pairs(rest, bits, n), sets))
    if not more.isEmpty():
        roots = joined(roots, more)
    return rows, roots.select(F.col("node").alias("class"), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: `doc_id`, `n_shingles`, `component_id`.

    `component_id` is the smallest id that links reach, the row's own included.
    Texts without words, empty or null, have no shingles and link with nothing,
    not even with each other.  Repeated rows are one id.  A row whose id is null
    links like any other; its component is null if it reaches no id.
    """
    rows, roots = classes_and_roots(docs, id_col, text_col)
    n = rows.count()
    by_class = rows.where("size > 0").groupBy("class").agg(F.min("id").alias("least"))
    by_class = few(by_class.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")), n)
    by_root = by_class.groupBy("root").agg(F.min("least").alias("component_id"))
    names = few(by_class.join(by_root, "root"), n).select(F.col("class").alias("k"), "component_id")
    found = few(rows.join(names, (F.col("class") == F.col("k")) & (F.col("size") > 0), "left"), n)
    return found.select(F.col("id").alias("doc_id"), F.col("size").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is the component's: one document of each group stays.

    Rows without an id stay.  Bits of the ids that go tell most rows that stay;
    only the others are joined with these ids, so few texts are shuffled.
    """
    found = near_duplicates(docs, id_col, text_col).where("component_id <> doc_id")
    gone = stored(found.select(F.xxhash64("doc_id").alias("class"), F.col("doc_id").alias("_gone")).distinct())
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(gone, gone.count()))
    key, flag = free_name(docs, "_key"), free_name(docs, "_flag")

    def start():
        return lambda batch: [pa.array(_holds(shared.value, batch.column(key).to_numpy()))]

    marked = append_columns(docs.withColumn(key, F.xxhash64(id_col)), [T.StructField(flag, T.BooleanType())], start)
    doubtful = marked.where(F.col(flag))
    stay = doubtful.join(gone, (doubtful[key] == gone["class"]) & (doubtful[id_col] == gone["_gone"]), "left_anti")
    return marked.where(~F.col(flag)).select(*docs.columns).union(stay.select(*docs.columns))
