"""Near duplicates of vectors by cross-polytope hashing.

Unit vectors are turned by random signs and fast Hadamard transforms; the axis
that a turned vector is closest to is its hash.  A table joins `k` such hashes to
one bucket; a vector also looks into the buckets it missed by least (multiprobe).
The number of tables is planned by hashing pairs at the threshold itself.  Signs
of further turns estimate the angle of two vectors that share a bucket; what may
link is verified by the exact cosine of the vectors.

Equal vectors are one class.  A large group of near copies would make pairs in
the square of its size, so groups get a centre first: vectors within half the
threshold's angle of one centre link with each other for certain, by the triangle
inequality.  Such a core is counted, not paired, and stands in every bucket once;
only what lies around it is compared with its vectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import acos, ceil, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import stored
from lattica.llm.components import components
from lattica.session import plain_unions

THRESHOLD = 0.95
MISSED = 0.0005  # share of pairs at the threshold that tables may miss in planning
PAIRS = 4000  # tried in planning
MOST_TABLES = 32
CROWD = 64  # vectors expected in a bucket by chance, at most
BITS = 128  # signs that estimate an angle
SLACK = 5.5  # standard deviations allowed to an estimate
CORE = 8  # near vectors that are worth a centre
CENTRE = 32  # of them that the centre is the mean of
TURNS = 3  # of signs and transforms per rotation
LEAST_WIDTH = 16  # that vectors are padded to; rotations of very few dimensions are too much alike


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast transform of the rows, whose length is a power of two."""
    n, width, step = *x.shape, 1
    while step < width:
        pairs = x.reshape(n, -1, 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / sqrt(width)


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one, also where squares would leave the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def width_of(length: int) -> int:
    return max(LEAST_WIDTH, 1 << (length - 1).bit_length())


@dataclass(frozen=True)
class Plan:
    """How vectors are hashed: tables, hashes joined to a bucket, buckets probed besides."""

    tables: int
    k: int
    probes: int


class Hasher:
    """Buckets and signs of vectors of one length, the same in every task."""

    def __init__(self, length: int, plan: Plan):
        self.plan, self.length = plan, length
        self.width = width_of(length)
        rng = np.random.default_rng(length)
        self.estimates = rng.choice([-1.0, 1.0], (ceil(BITS / self.width), TURNS, self.width))
        self.turns = rng.choice([-1.0, 1.0], (plan.tables, plan.k, TURNS, self.width))
        self.factors = rng.integers(1, 1 << 63, plan.k, np.uint64) | np.uint64(1)

    def _rotated(self, x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        for s in signs:
            x = hadamard(x * s)
        return x

    def _padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.width - x.shape[1])))

    def signs(self, x: np.ndarray) -> np.ndarray:
        """BITS signs of each row as 64-bit numbers."""
        y = np.hstack([self._rotated(self._padded(x), s) for s in self.estimates])
        return np.packbits(y[:, :BITS] > 0, axis=1).view(np.int64)

    def buckets(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own bucket in each table (rows x tables), and those probed besides (rows x tables x probes)."""
        x, plan = self._padded(x), self.plan
        near = min(self.width, 1 + plan.probes)
        own, probed = [], []
        with np.errstate(over="ignore"):
            for t in range(plan.tables):
                start = np.uint64((self.length * MOST_TABLES + t) * 0x9E3779B97F4A7C15 % (1 << 64))
                codes, margins = [], []
                for signs in self.turns[t]:
                    y = self._rotated(x, signs)
                    order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :near]
                    size = np.take_along_axis(y, order, 1)
                    codes.append((2 * order + (size < 0)).astype(np.uint64))
                    margins.append(np.abs(size[:, :1]) - np.abs(size[:, 1:]))
                bucket = start + sum(c[:, 0] * f for c, f in zip(codes, self.factors))
                # One hash replaced by its next best axes, those missed by least first.
                other = np.hstack([bucket[:, None] + (c[:, 1:] - c[:, :1]) * f for c, f in zip(codes, self.factors)])
                best = np.argsort(np.hstack(margins), axis=1, kind="stable")[:, : plan.probes]
                own.append(bucket)
                probed.append(np.take_along_axis(other, best, 1))
        return np.stack(own, 1).view(np.int64), np.stack(probed, 1).view(np.int64)


def planned(length: int, rows: int, threshold: float = THRESHOLD) -> Plan:
    """Hashes per bucket by the number of rows, tables by pairs at the threshold."""
    width = width_of(length)
    k = max(1, ceil(log(max(rows / CROWD, 1)) / log(2 * width)))
    probes = 2 * k
    rng = np.random.default_rng(7)
    a = units(rng.standard_normal((PAIRS, length)))
    if length == 1:
        return Plan(1, k, min(probes, k))
    turn = rng.standard_normal((PAIRS, length))
    turn = units(turn - (turn * a).sum(1, keepdims=True) * a)
    b = threshold * a + sqrt(1 - threshold * threshold) * turn
    (x, px), (y, py) = (Hasher(length, Plan(MOST_TABLES, k, probes)).buckets(z) for z in (a, b))
    met = (x == y) | (x[:, :, None] == py).any(2) | (y[:, :, None] == px).any(2)
    missed = 1 - np.maximum.accumulate(met, axis=1).mean(0)
    enough = np.flatnonzero(missed <= MISSED)
    return Plan(int(enough[0]) + 1 if len(enough) else MOST_TABLES, k, probes)


def differing(angle: float) -> int:
    """Signs that vectors at `angle` differ in, at most."""
    share = min(angle / pi, 0.5)
    return int(BITS * share + SLACK * sqrt(BITS * share * (1 - share)))


def _matrices(column: pa.Array):
    """(rows, matrix) for each length of vectors in the column."""
    lengths = np.array(column.value_lengths().to_pylist(), np.int64)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), length)


def _longs(rows: np.ndarray) -> pa.Array:
    return pa.array(list(rows), pa.list_(pa.int64()))


def read(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(`id`, `h1`, `h2`, `length`) of every row, digests null where the vector takes no part; and the rows that do, with `v`.

    Null and zero vectors, and those with a null or non-finite component, take no part.
    """
    v = F.col("v")
    usable = F.coalesce(v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).withColumn("v", F.when(usable, v))
    keyed = rows.select("id", "v", F.when(v.isNotNull(), F.xxhash64("v")).alias("h1"), F.when(v.isNotNull(), F.xxhash64(F.lit(1), "v")).alias("h2"), F.size("v").alias("length"))
    return stored(keyed.drop("v")), keyed.where("h1 IS NOT NULL")


def classes_of(usable: DataFrame, plan: Plan) -> DataFrame:
    """Distinct vectors: `c`, `v`, smallest id, rows, signs `s` and buckets `own` and `probed`."""
    grouped = usable.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.min("id").alias("least"), F.count("*").alias("n"))
    numbered = grouped.select(F.monotonically_increasing_id().alias("c"), "h1", "h2", "v", "least", "n")

    def hashed(batches):
        hashers: dict[int, Hasher] = {}
        for batch in filter(len, batches):
            signs, own = np.zeros((len(batch), BITS // 64), np.int64), np.zeros((len(batch), plan.tables), np.int64)
            probed: list = [None] * len(batch)
            for at, x in _matrices(batch.column("v")):
                hasher = hashers.setdefault(x.shape[1], Hasher(x.shape[1], plan))
                x = units(x)
                signs[at] = hasher.signs(x)
                own[at], others = hasher.buckets(x)
                for i, found in zip(at.tolist(), others.reshape(len(at), -1)):
                    probed[i] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, _longs(signs), _longs(own), pa.array(probed, pa.list_(pa.int64()))], names=[*batch.schema.names, "s", "own", "probed"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema)
    return stored(numbered.mapInArrow(hashed, f"{fields}, s array<long>, own array<long>, probed array<long>"))


def _signs(prefix: str = "") -> list[Column]:
    return [F.col("s")[i].alias(f"{prefix}s{i}") for i in range(BITS // 64)]


def _apart(a: str, b: str) -> Column:
    """Signs that two rows differ in."""
    return sum((F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))) for i in range(BITS // 64)), F.lit(0))


def with_cosine(pairs: DataFrame, a: str, b: str, keep: list[str], least: float) -> DataFrame:
    """The columns `keep` and the exact `cosine` of the vectors `a` and `b`, where it is `least` or more."""

    def run(batches):
        for batch in filter(len, batches):
            cosines = np.zeros(len(batch))
            other = batch.column(b)
            for at, x in _matrices(batch.column(a)):
                y = other.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(x.shape)
                cosines[at] = (units(x) * units(y)).sum(1)
            good = pa.array(np.flatnonzero(cosines >= least))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(good) for c in keep), pa.array(cosines).take(good)], names=[*keep, "cosine"])

    fields = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in keep)
    return pairs.select(*keep, a, b).mapInArrow(run, f"{fields}, cosine double")


def cores(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(`c`, `root`) of the classes close to a centre, and (`root`, `s0`...) with the signs of each centre.

    All classes of a core lie within half the threshold's angle of its centre.
    """
    half = acos(threshold) / 2
    entries = classes.select("c", *_signs(), F.explode("own").alias("bucket"))
    first = F.min(F.struct("c", *[f"s{i}" for i in range(BITS // 64)])).alias("p")
    pivots = entries.groupBy("bucket").agg(first).select("bucket", F.col("p.c").alias("up"), *[F.col(f"p.s{i}").alias(f"p_s{i}") for i in range(BITS // 64)])
    near = entries.join(pivots, "bucket").where(_apart("", "p_") <= differing(half))
    steps = stored(near.groupBy("c").agg(F.min("up").alias("up")))
    above = steps.select(F.col("c").alias("up"), F.col("up").alias("root"))
    rooted = steps.join(above, "up", "left").select("c", F.coalesce("root", "up").alias("root"))
    large = rooted.groupBy("root").count().where(F.col("count") >= CORE).select("root")
    grouped = stored(rooted.join(large, "root", "left_semi").join(classes.select("c", "v"), "c"))
    few = Window.partitionBy("root").orderBy(F.xxhash64("c"), "c")
    chosen = grouped.withColumn("place", F.row_number().over(few)).where(F.col("place") <= CENTRE).groupBy("root").agg(F.collect_list("v").alias("vs"))

    def centred(batches):
        for batch in filter(len, batches):
            roots, means, signs = [], [], []
            for root, vs in zip(batch.column("root").to_pylist(), batch.column("vs").to_pylist()):
                mean = units(np.array(vs, float)).mean(0)
                if mean.any():
                    unit = units(mean[None])
                    roots.append(root)
                    means.append(unit[0].tolist())
                    signs.append(Hasher(unit.shape[1], Plan(0, 1, 0)).signs(unit)[0])
            yield pa.RecordBatch.from_arrays([pa.array(roots, pa.int64()), pa.array(means, pa.list_(pa.float64())), pa.array(signs, pa.list_(pa.int64()))], names=["root", "centre", "s"])

    centres = stored(chosen.mapInArrow(centred, "root long, centre array<double>, s array<long>"))
    # A hair less than half, so that rounding cannot admit a pair below the threshold.
    core = with_cosine(grouped.join(centres.select("root", "centre"), "root"), "v", "centre", ["c", "root"], float(np.cos(half - 1e-7)))
    return stored(core.select("c", "root")), centres.select("root", *_signs())


def candidates(classes: DataFrame, core: DataFrame, centres: DataFrame, threshold: float) -> DataFrame:
    """(`a`, `b`) with a < b: pairs of classes that may link, but for those of one core."""
    angle = acos(threshold)
    loose = classes.join(core.select("c"), "c", "left_anti").select((F.col("c") * 2).alias("unit"), *_signs(), "own", "probed")
    names = [f"s{i}" for i in range(BITS // 64)]
    # A core is one unit wherever one of its classes lies.
    places = classes.select("c", "own", "probed").join(core, "c")
    both = lambda df, *cols: df.select(*cols, F.explode("own").alias("bucket"), F.lit(True).alias("home")).union(df.select(*cols, F.explode("probed"), F.lit(False)))
    crowded = both(places, "root").groupBy("bucket", "root").agg(F.max("home").alias("home")).join(centres, "root")
    entries = both(loose, "unit", *names).select("bucket", "unit", "home", F.lit(0).alias("wide"), *names)
    entries = entries.union(crowded.select("bucket", (F.col("root") * 2 + 1).alias("unit"), "home", F.lit(1).alias("wide"), *names))
    left = entries.where("home").select("bucket", *[F.col(c).alias(f"a_{c}") for c in ("unit", "wide", *names)])
    right = entries.select("bucket", *[F.col(c).alias(f"b_{c}") for c in ("unit", "wide", *names)])
    limits = F.array(*[F.lit(differing(angle * (1 + w / 2))) for w in range(3)])
    met = left.join(right, "bucket").where((F.col("a_unit") != F.col("b_unit")) & (_apart("a_", "b_") <= limits[F.col("a_wide") + F.col("b_wide")]))
    pairs = stored(met.select(F.least("a_unit", "b_unit").alias("x"), F.greatest("a_unit", "b_unit").alias("y")).distinct())
    plain = (F.col("x") % 2 == 0) & (F.col("y") % 2 == 0)
    members = core.select((F.col("root") * 2 + 1).alias("unit"), "c")
    opened = pairs.where(~plain)
    for side, name in (("x", "a"), ("y", "b")):
        inside = opened.where(F.col(side) % 2 == 1).join(members.select(F.col("unit").alias(side), F.col("c").alias(name)), side)
        single = opened.where(F.col(side) % 2 == 0).withColumn(name, F.shiftright(side, 1))
        opened = inside.unionByName(single)
    found = pairs.where(plain).select(F.shiftright("x", 1).alias("a"), F.shiftright("y", 1).alias("b")).union(opened.select("a", "b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row: `vec_id`, `n_links`, `component_id`, `kept`.

    Rows link when their cosine is at least `threshold`; equal vectors always do,
    repeated rows too, each of which counts as a vector.  Vectors of different
    lengths never link.  Rows that take no part have no links and are their own
    component.  Rows of one id with different vectors are different vectors.  A row
    whose id is null links like any other; a component of nothing but such rows is
    null.
    """
    spark = vectors.sparkSession
    plain_unions(spark)
    rows, usable = read(vectors, id_col, vector_col)
    seen = rows.where("h1 IS NOT NULL").agg(F.count("*").alias("n"), F.max("length").alias("length")).first()
    if not seen.n:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    plan = planned(seen.length, seen.n, threshold)
    classes = classes_of(usable, plan)
    core, centres = cores(classes, threshold)
    ends = lambda name: classes.select(F.col("c").alias(name), F.col("v").alias(f"v{name}"), F.col("least").alias(f"least_{name}"), F.col("n").alias(f"n_{name}"))
    pairs = candidates(classes, core, centres, threshold).join(ends("a"), "a").join(ends("b"), "b").where(F.size("va") == F.size("vb"))
    links = stored(with_cosine(pairs, "va", "vb", ["a", "b", "least_a", "least_b", "n_a", "n_b"], threshold))
    linked = links.select(F.col("a").alias("c"), F.col("n_b").alias("n")).union(links.select("b", "n_a")).groupBy("c").agg(F.sum("n").alias("linked"))
    of_core = stored(core.join(classes.select("c", "least", "n"), "c"))
    by_core = of_core.groupBy("root").agg(F.sum("n").alias("weight"), F.min(_node("least", "c")).alias("head"))
    inside = stored(of_core.join(by_core, "root").select("c", _node("least", "c").alias("node"), "head", (F.col("weight") - F.col("n")).alias("inside")))
    # Nodes are ordered by id, so the smallest node of a component tells its id.
    edges = links.select(_node("least_a", "a").alias("a"), _node("least_b", "b").alias("b")).union(inside.select("node", "head"))
    found = components(edges).select(F.col("node.c").alias("c"), F.col("root.id").alias("component"))
    total = (F.col("n") - 1 + F.coalesce("linked", F.lit(0)) + F.coalesce("inside", F.lit(0))).cast("bigint")
    known = classes.select("c", "h1", "h2", "least", "n").join(linked, "c", "left").join(inside.select("c", "inside"), "c", "left").join(found, "c", "left")
    known = known.select("h1", "h2", total.alias("n_links"), F.coalesce("component", "least").alias("component"))
    out = rows.join(known, ["h1", "h2"], "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))
    return out.select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _node(least: str, c: str) -> Column:
    return F.struct(F.col(least).isNull().alias("missing"), F.col(least).alias("id"), F.col(c).alias("c"))
