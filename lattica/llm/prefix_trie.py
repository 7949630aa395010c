"""Prefix trie of conversations, screened by a count-min sketch.

A turn becomes a digest where it is read, so texts are never shuffled.  Turns
are sorted by ranges of (conversation, turn): a conversation of any length may
span tasks.  The digest of a prefix is a polynomial in the digests of its turns
modulo a prime, so a prefix that starts in another conversation, or in another
task, is put together from the sums of its parts.

Counters of all prefixes are added up in a count-min sketch.  An estimate of one
proves that a single conversation has the prefix, and then all longer ones too:
that tail of the conversation is written where it lies.  The first such prefix
of a conversation and those that may be shared are grouped exactly.  A full
sketch proves nothing and costs a larger shuffle, never a result.
"""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import stored
from lattica.session import plain_unions

PRIME = (1 << 127) - 1
BASE = int.from_bytes(sha256(b"prefix").digest()[:15], "little")
HEADS = 8  # most turns that a conversation takes from its base
GROUP = 5  # a conversation's base is the one whose id is the multiple of this below
COUNTERS = (1 << 16, 1 << 25)  # least and most of a row of the sketch: 2 rows of 2 bits, 16 MB at most
PER_PREFIX = 8  # counters wanted for each prefix
BLOCK = 1 << 16  # counters that travel together
SEGMENT = 4096  # depths of a conversation that are summed in one group
PIECE = 1 << 16  # bytes of ids that are joined before they are hashed
_ZERO = bytes(16)
# (BASE ** -n) modulo PRIME
_BACK = [pow(BASE, -n, PRIME) for n in range(HEADS + 1)]


def _number(data: bytes) -> int:
    return int.from_bytes(data, "little")


def _bytes(number: int) -> bytes:
    return number.to_bytes(16, "little")


def turns(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(`conv`, `turn`, `mark`, `size`): digest of role and text, and bytes of the text, of each row with an id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    rows = conversations.where(F.col(conv_col).isNotNull())
    return rows.select(F.col(conv_col).cast("bigint").alias("conv"), "turn", mark.alias("mark"), F.octet_length(text).cast("bigint").alias("size"))


def _local_sums(rows: DataFrame) -> DataFrame:
    """Turns in order, with the sum of each conversation before and after the turn, as far as the task goes."""

    def run(batches):
        part, conv, place, total, power = TaskContext.get().partitionId(), None, 0, 0, 1
        for batch in batches:
            places, before, after = [], [], []
            for c, mark in zip(batch.column("conv").to_pylist(), batch.column("mark").to_pylist()):
                if c != conv:
                    conv, place, total, power = c, 0, 0, 1
                places.append(place)
                before.append(_bytes(total))
                total = (total + _number(mark) * power) % PRIME
                power = power * BASE % PRIME
                place += 1
                after.append(_bytes(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(places), pa.int32()), batch.column("conv"), pa.array(places, pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary()), batch.column("size")],
                names=["part", "conv", "place", "before", "after", "size"],
            )

    dealt = rows.repartitionByRange("conv", "turn").sortWithinPartitions("conv", "turn", "mark")
    return dealt.mapInArrow(run, "part int, conv long, place long, before binary, after binary, size long")


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Turns with their `place` in the conversation and the sums `before` and `after` them.

    Order is by turn, null first; equal turns are ordered by their digest.
    """
    local = stored(_local_sums(turns(conversations, conv_col)))
    # One row per task: which conversations reach over its ends.
    ends = sorted(local.groupBy("part").agg(F.min("conv").alias("first"), F.max("conv").alias("last")).collect())
    cut = [(a.part, b.part, b.first) for a, b in zip(ends, ends[1:]) if a["last"] == b["first"]]
    if not cut:
        return local
    wanted = local.sparkSession.createDataFrame([(p, c) for a, b, c in cut for p in (a, b)], "part int, conv long").distinct()
    parts = local.join(F.broadcast(wanted), ["part", "conv"]).groupBy("part", "conv").agg(F.max("place").alias("place"), F.max_by("after", "place").alias("after")).collect()
    sums = {(r.part, r.conv): (r.place + 1, _number(r.after)) for r in parts}
    shifts: dict[tuple[int, int], tuple[int, int]] = {}
    for a, b, conv in cut:
        start, total = shifts.get((a, conv), (0, 0))
        count, more = sums[a, conv]
        shifts[b, conv] = (start + count, (total + more * pow(BASE, start, PRIME)) % PRIME)
    shared = local.sparkSession.sparkContext.broadcast({k: (n, t, pow(BASE, n, PRIME)) for k, (n, t) in shifts.items()})

    def move(batches):
        for batch in batches:
            places, before, after = (batch.column(c).to_pylist() for c in ("place", "before", "after"))
            for i, key in enumerate(zip(batch.column("part").to_pylist(), batch.column("conv").to_pylist())):
                if key in shared.value:
                    n, total, power = shared.value[key]
                    places[i] += n
                    before[i], after[i] = (_bytes((total + _number(x[i]) * power) % PRIME) for x in (before, after))
            columns = [batch.column("part"), batch.column("conv"), pa.array(places, pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary()), batch.column("size")]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return stored(local.mapInArrow(move, local.schema))


def rebuilt(ordered: DataFrame) -> DataFrame:
    """One row per rebuilt conversation and prefix, the empty one included: `conv`, `depth`, `key`, `parent`, `size`, `last`.

    `key` is the digest of the prefix, `parent` that of the one before, `size` the
    bytes of its last text and `last` the length of the whole conversation.
    """
    head = F.when(F.col("place") < HEADS, F.struct("place", "after", "size"))
    convs = stored(ordered.groupBy("conv").agg((F.max("place") + 1).alias("n"), F.array_sort(F.collect_list(head)).alias("heads")))
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % (HEADS + 1)
    bases = convs.select(F.col("conv").alias("base"), F.col("heads").alias("base_heads"))
    own = convs.withColumn("h", taken.cast("int")).withColumn("base", F.col("conv") - F.col("conv") % GROUP)
    path = F.coalesce(F.slice("base_heads", F.lit(1), F.col("h")), F.slice("heads", 1, 0))
    joined = own.join(bases, "base", "left").withColumn("path", path).withColumn("k", F.size("path"))
    zero = F.lit(_ZERO)
    plan = stored(joined.select(
        "conv", "n", "h", "k", "path",
        F.when(F.col("k") > 0, F.try_element_at("path", F.col("k"))["after"]).otherwise(zero).alias("start"),
        F.when((F.col("h") > 0) & (F.col("n") > F.col("h")), F.try_element_at("heads", F.col("h"))["after"]).otherwise(zero).alias("skipped"),
        (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("bigint").alias("last"),
    ))
    none = F.struct(F.lit(-1).cast("bigint").alias("place"), zero.alias("after"), F.lit(0).cast("bigint").alias("size"))
    steps = plan.select("conv", "last", F.concat(F.array(none), "path").alias("steps"))
    steps = steps.select("conv", "last", "steps", F.posexplode("steps").alias("depth", "step"))
    first = steps.select("conv", F.col("depth").cast("bigint").alias("depth"), F.col("step.after").alias("key"),
                         F.when(F.col("depth") > 0, F.get("steps", F.col("depth") - 1)["after"]).alias("parent"), F.col("step.size").alias("size"), "last")

    def join(batches):
        for batch in batches:
            keys, parents = [], []
            columns = (batch.column(c).to_pylist() for c in ("before", "after", "start", "skipped", "h", "k"))
            for before, after, start, skipped, h, k in zip(*columns):
                at, gone, back = _number(start), _number(skipped), _BACK[h - k]
                keys.append(_bytes((at + (_number(after) - gone) * back) % PRIME))
                parents.append(_bytes((at + (_number(before) - gone) * back) % PRIME))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("depth"), pa.array(keys, pa.binary()), pa.array(parents, pa.binary()), batch.column("size"), batch.column("last")],
                names=["conv", "depth", "key", "parent", "size", "last"],
            )

    own_turns = ordered.join(plan.where("n > h").select("conv", "h", "k", "start", "skipped", "last"), "conv").where("place >= h")
    own_turns = own_turns.select("conv", (F.col("k") + F.col("place") - F.col("h") + 1).alias("depth"), "before", "after", "start", "skipped", "h", "k", "size", "last")
    return first.unionByName(own_turns.mapInArrow(join, "conv long, depth long, key binary, parent binary, size long, last long"))


def _places(keys: pa.Array, width: int) -> np.ndarray:
    """Counter of each key in both rows of the sketch; the second row lies behind the first."""
    halves = np.frombuffer(b"".join(keys.to_pylist()), "<u8").reshape(-1, 2) & np.uint64(width - 1)
    return halves.astype(np.int64) + np.array([0, width])


def _pack(counters: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(np.stack([counters & 1, counters >> 1]), axis=None).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    low, high = np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8)).reshape(2, -1)
    return low + 2 * high


def screen(prefixes: DataFrame, width: int) -> np.ndarray:
    """Bits that tell which counters of the sketch stand at one; counters stop at two.

    Tasks send the blocks of counters that they touched; their sums, of a bounded
    size whatever the input, meet in the driver.
    """
    schema = "block int, counters binary"

    def emit(found: dict[int, np.ndarray]):
        for block, counters in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_pack(counters)], pa.binary())], names=["block", "counters"])

    def count(batches):
        sketch = np.zeros(2 * width, np.uint8)
        for batch in filter(len, batches):
            for column in _places(batch.column("key"), width).T:
                at, n = np.unique(column, return_counts=True)
                sketch[at] = np.minimum(sketch[at] + np.minimum(n, 2), 2)
        blocks = sketch.reshape(-1, BLOCK)
        yield from emit({int(b): blocks[b] for b in np.flatnonzero(blocks.any(1))})

    def add(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("counters").to_pylist()):
                counters = _unpack(data)
                found[block] = np.minimum(found[block] + counters, 2) if block in found else counters
        yield from emit(found)

    ones = np.zeros(2 * width, bool)
    for r in prefixes.select("key").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect():
        ones[r.block * BLOCK : (r.block + 1) * BLOCK] = _unpack(r.counters) == 1
    return np.packbits(ones)


def with_tails(prefixes: DataFrame, ones: np.ndarray, width: int) -> DataFrame:
    """`prefixes` and `tail`: whether a shorter prefix of the conversation is proven to be its own alone."""
    shared = prefixes.sparkSession.sparkContext.broadcast(ones)

    def run(batches):
        bits, conv, first = shared.value, None, None
        for batch in filter(len, batches):
            at = _places(batch.column("key"), width)
            alone = (((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).any(1)).tolist()
            tails = []
            for c, depth, single in zip(batch.column("conv").to_pylist(), batch.column("depth").to_pylist(), alone):
                if c != conv:
                    conv, first = c, None
                tails.append(first is not None and depth > first)
                if single and (first is None or depth < first):
                    first = depth
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tails)], names=[*batch.schema.names, "tail"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prefixes.schema)
    return prefixes.mapInArrow(run, f"{schema}, tail boolean")


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("string").cast("binary"), 256)


def _end_digests(ends: DataFrame) -> DataFrame:
    """(`depth`, `key`, `ends`): SHA-256 of the ids of each node, ascending and comma-joined.

    Sorting and joining are spread, whatever the size of a node; only the hash
    function itself runs through the joined pieces of a node one after another.
    """
    piece_schema, schema = "depth long, key binary, first long, ids string", "depth long, key binary, ends string"

    def joined(batches):
        node, first, ids, size = None, 0, [], 0

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]], pa.binary()), pa.array([first]), pa.array([",".join(ids)])], names=["depth", "key", "first", "ids"])

        for batch in batches:
            for depth, key, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "key", "conv"))):
                if node is not None and (node != (depth, key) or size > PIECE):
                    yield piece()
                    ids, size = [], 0
                if not ids:
                    node, first = (depth, key), conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if ids:
            yield piece()

    def hashed(batches):
        node, state = None, sha256()
        for batch in batches:
            for depth, key, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "key", "ids"))):
                if node == (depth, key):
                    state.update(b",")
                else:
                    if node is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]], pa.binary()), pa.array([state.hexdigest()])], names=["depth", "key", "ends"])
                    node, state = (depth, key), sha256()
                state.update(ids.encode())
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]], pa.binary()), pa.array([state.hexdigest()])], names=["depth", "key", "ends"])

    dealt = ends.select("depth", "key", "conv").repartitionByRange("depth", "key", "conv").sortWithinPartitions("depth", "key", "conv")
    pieces = dealt.mapInArrow(joined, piece_schema).repartition("depth", "key").sortWithinPartitions("depth", "key", "first")
    return pieces.mapInArrow(hashed, schema)


def _subtree_sums(shared: DataFrame, values: DataFrame) -> DataFrame:
    """(`depth`, `key`, `leaves`, `saved`): sums over the subtree of each node.

    A node's own value lies with its smallest member, at the node's depth.  The
    subtree of a node is what its members hold at its depth and below, so sums
    along each conversation are added up by node, without a loop over levels.
    """
    segment = F.floor(F.col("depth") / SEGMENT).cast("bigint").alias("segment")
    zero = F.lit(0).cast("bigint")
    rows = shared.select("conv", segment, "depth", "key", zero.alias("leaf"), zero.alias("value"))
    held = values.select("conv", segment, "depth", F.lit(None).cast("binary").alias("key"), "leaf", "value")
    deep = shared.where(F.col("last") >= SEGMENT).select("conv", segment, zero.alias("leaf"), zero.alias("value"))
    deep = deep.union(values.where(F.col("depth") >= SEGMENT).select("conv", segment, "leaf", "value")).groupBy("conv", "segment").agg(F.sum("leaf").alias("leaf"), F.sum("value").alias("value"))
    further = Window.partitionBy("conv").orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)
    below = deep.select("conv", "segment", F.sum("leaf").over(further).alias("more_leaves"), F.sum("value").over(further).alias("more_value"))
    along = Window.partitionBy("conv", "segment").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.union(held).join(below, ["conv", "segment"], "left").select(
        "depth", "key",
        (F.sum("leaf").over(along) + F.coalesce("more_leaves", zero)).alias("leaves"),
        (F.sum("value").over(along) + F.coalesce("more_value", zero)).alias("saved"),
    )
    return summed.where("key IS NOT NULL").groupBy("depth", "key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def trie(conversations: DataFrame, conv_col: str = "conv_id", counters: tuple[int, int] = COUNTERS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    Null roles and texts are empty; rows without a conversation id are left out;
    repeated rows are turns of their own.  Turns with one number are ordered by a
    digest of role and text.  An empty table has no nodes, not even a root.
    """
    plain_unions(conversations.sparkSession)
    prefixes = stored(rebuilt(ordered_turns(conversations, conv_col)))
    least, most = counters
    width = min(max(least, 1 << (PER_PREFIX * prefixes.count()).bit_length()), most)
    marked = stored(with_tails(prefixes, screen(prefixes, width), width))
    shared = marked.where("NOT tail")
    ends_here = F.col("depth") == F.col("last")
    nodes = stored(shared.groupBy("depth", "key").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n"), F.min("parent").alias("parent"), F.min("size").alias("size"), F.max("last").alias("last"),
        F.count(F.when(ends_here, 1)).alias("n_ends"), F.min(F.when(ends_here, F.col("conv"))).alias("an_end"),
    ))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("key")).agg(F.count("*").alias("children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent"), F.col("conv").alias("parent_conv"), F.col("n").alias("parent_n"))
    known = nodes.join(children, ["depth", "key"], "left").join(above, ["depth", "parent"], "left")
    # The parent of a node that one conversation has may be a tail, written where it lies.
    single = F.col("n") == 1
    leaf = F.when(single, (F.col("depth") == 0) | (F.coalesce("parent_n", F.lit(0)) > 1)).otherwise(F.col("children").isNull())
    nodes = stored(known.select(
        "depth", "key", "conv", "n", "n_ends", "an_end", leaf.cast("bigint").alias("leaf"), ((F.col("n") - 1) * F.col("size")).alias("value"),
        F.when(F.col("depth") > 0, F.coalesce("parent_conv", "conv")).alias("parent_conv"),
        F.when(single, (F.col("depth") < F.col("last")).cast("bigint")).otherwise(F.coalesce("children", F.lit(0).cast("bigint"))).alias("children"),
    ))
    sums = _subtree_sums(shared, nodes.where("leaf > 0 OR value > 0").select("conv", "depth", "leaf", "value"))
    several = nodes.where("n_ends > 1").select("depth", "key")
    ends = _end_digests(shared.where(ends_here).join(several, ["depth", "key"]))
    one = F.lit(1).cast("bigint")
    none = F.lit(0).cast("bigint")
    grouped = nodes.join(sums, ["depth", "key"], "left").join(ends, ["depth", "key"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.when(single, one).otherwise(F.col("leaves")).alias("n_leaves"), F.when(single, none).otherwise(F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends", _digest(F.coalesce(F.col("an_end").cast("string"), F.lit("")))).alias("ends_sha256"),
    )
    tails = marked.where("tail").select(
        F.col("conv").alias("conv_id"), "depth", F.col("conv").alias("parent_conv_id"), one.alias("n_convs"), (F.col("depth") < F.col("last")).cast("bigint").alias("n_children"),
        one.alias("n_leaves"), none.alias("saved_tokens"), _digest(F.when(ends_here, F.col("conv").cast("string")).otherwise("")).alias("ends_sha256"),
    )
    return grouped.union(tails)
