"""Class-based bigram language model in the manner of Brown et al., scored on whole texts.

P(text) is the product over tokens of P(class | class before) P(word | class).

* The `CORE` most frequent words are clustered by exchange: words move between
  classes as long as that raises the likelihood of the bigrams of core words.
* Every other training word then moves to the class where it raises that
  likelihood most, by its bigrams with core words before and behind it.  Their
  counts are a table that grows with the corpus, a row for each word's bucket;
  buckets grow with the vocabulary, several for each word.  A word that never
  meets a core word, and a word that training lacks, takes the class that most
  words of its ending have.
* Transitions between classes and the size of each class are counted on all
  texts and all words under these classes.

Counts of all words are a table.  Its head, `HEAD` words, is broadcast; words
beyond it are joined with the table, so any vocabulary can be scored exactly.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import ASCII_LOWER, stored, texts_of

HEAD = 100_000  # words whose counts are broadcast
CORE = 1024  # words whose bigrams are a matrix
ENDINGS = 256  # groups of words of like ending
ENDING = 3  # bytes of an ending
CLASSES = 64
SWEEPS = 12  # of exchange clustering, at most
PRIOR = 5.0  # weight of the class frequencies in a transition
PER_WORD = 8  # buckets for each word of the vocabulary
BUCKETS = (1 << 16, 1 << 26)  # fewest and most, a byte each in the broadcast
SHARD = 1 << 13  # buckets whose contexts are added up together
HELD = 400_000  # distinct words a task counts before it passes them on
PENDING = 4_000_000  # contexts a task gathers before it passes them on
UNKNOWN = 255
END = b"\n"  # behind every text; no word holds it


def tokens_of(text: bytes | None) -> list[bytes]:
    """Lower-case words and the end; a null is an empty text."""
    words = (text or b"").translate(ASCII_LOWER).split()
    words.append(END)
    return words


def word_counts(texts: DataFrame) -> DataFrame:
    """(`word`, `n`) of all tokens of the column `text`."""

    def count(batches):
        def table(counts):
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for text in texts_of(batch.column("text")):
                counts.update(tokens_of(text))
            if len(counts) > HELD:
                yield table(counts)
                counts = Counter()
        yield table(counts)

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def batch_tokens(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """Tokens of all texts in a row, and where each text starts.

    Every text ends with END, so the token before a text is what it has to be.
    """
    each = [tokens_of(t) for t in texts]
    starts = np.cumsum([0, *map(len, each)])[:-1]
    return [w for words in each for w in words], starts


def numbers_of(tokens: list[bytes], numbers: dict[bytes, int]) -> np.ndarray:
    """Number of each token, -1 without one."""
    return np.fromiter(map(numbers.get, tokens, repeat(-1)), np.int64, len(tokens))


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.int64, len(words))


def ending_of(word: bytes) -> int:
    return crc32(word[-ENDING:]) % ENDINGS


@dataclass(frozen=True)
class Classes:
    """The class of any word: its own in the core, else that of its bucket, else that of its ending."""

    core: dict[bytes, int]
    buckets: np.ndarray
    endings: np.ndarray

    def outside(self, words: list[bytes]) -> np.ndarray:
        """Classes of words that are not in the core."""
        found = self.buckets[hashes_of(words) & (len(self.buckets) - 1)].astype(np.int64)
        lost = np.flatnonzero(found == UNKNOWN)
        found[lost] = self.endings[[ending_of(words[i]) for i in lost.tolist()]]
        return found

    def read(self, tokens: list[bytes]) -> np.ndarray:
        found = numbers_of(tokens, self.core)
        rest = np.flatnonzero(found < 0)
        found[rest] = self.outside([tokens[i] for i in rest.tolist()])
        return found

    def of(self, word: bytes) -> int:
        return int(self.read([word])[0])


def _summed_matrix(texts: DataFrame, size: int, codes) -> np.ndarray:
    """How often one code follows another; `codes()` gives, in a task, the function from tokens to codes, -1 for none."""

    def count(batches):
        read, sums = codes(), np.zeros(size * size, np.int64)
        end = int(read([END])[0])
        for batch in batches:
            tokens, _ = batch_tokens(texts_of(batch.column("text")))
            after = read(tokens)
            before = np.concatenate([[end], after[:-1]])
            both = (before >= 0) & (after >= 0)
            sums += np.bincount(before[both] * size + after[both], minlength=size * size)
        rows = sums.reshape(size, size)
        used = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([zlib.compress(rows[i].tobytes(), 1) for i in used], pa.binary())], names=["code", "row"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for code, row in zip(batch.column("code").to_pylist(), batch.column("row").to_pylist()):
                sums[code] = sums.get(code, 0) + np.frombuffer(zlib.decompress(row), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["code", "row"])

    total = np.zeros((size, size))
    for r in texts.mapInArrow(count, "code long, row binary").repartition("code").mapInArrow(add, "code long, row binary").collect():
        total[r.code] = np.frombuffer(r.row, np.int64)
    return total


def affinities(table: np.ndarray) -> np.ndarray:
    """What a word gains in each class (columns) for each class behind it, then before it (rows).

    The first-order change of the likelihood of class bigrams when a word's
    bigrams are added to a class.
    """
    smooth = table + 0.1
    gain = np.log(smooth) - np.log(smooth.sum(1, keepdims=True)) - np.log(smooth.sum(0, keepdims=True)) + np.log(smooth.sum())
    return np.vstack([gain.T, gain])


def bucket_classes(texts: DataFrame, core: dict[bytes, int], table: np.ndarray, buckets: int) -> np.ndarray:
    """Class of each bucket of words outside the core by their bigrams with core words; UNKNOWN without any."""
    classes = len(table)
    width = 2 * classes
    shared = texts.sparkSession.sparkContext.broadcast((core, affinities(table)))

    def packed(keys: np.ndarray):
        keys, counts = np.unique(keys, return_counts=True)
        shards = keys // (SHARD * width)
        cuts = np.flatnonzero(np.diff(shards, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(keys)]):
            data = (keys[a:b] % (SHARD * width)).astype("<u4").tobytes() + counts[a:b].astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([int(shards[a])], pa.int32()), pa.array([zlib.compress(data, 1)], pa.binary())], names=["shard", "contexts"])

    def gather(batches):
        core, _ = shared.value
        end, pending, size = core.get(END, -1), [], 0
        for batch in batches:
            tokens, starts = batch_tokens(texts_of(batch.column("text")))
            codes = numbers_of(tokens, core)
            before, behind = np.concatenate([[end], codes[:-1]]), np.append(codes[1:], -1)
            behind[starts[1:] - 1] = -1  # nothing follows the end of a text
            known = np.flatnonzero((codes < 0) & ((before >= 0) | (behind >= 0)))
            place = (hashes_of([tokens[i] for i in known.tolist()]) & (buckets - 1)) * width
            before, behind = before[known], behind[known]
            pending += [place[behind >= 0] + behind[behind >= 0], place[before >= 0] + classes + before[before >= 0]]
            size += len(known)
            if size > PENDING:
                yield from packed(np.concatenate(pending))
                pending, size = [], 0
        if pending:
            yield from packed(np.concatenate(pending))

    def choose(batches):
        gains = shared.value[1]
        shard, sums = None, None

        def chosen():
            labels = np.where(sums.any(1), (sums @ gains).argmax(1), UNKNOWN).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([labels.tobytes()], pa.binary())], names=["shard", "labels"])

        for batch in batches:
            for number, data in zip(batch.column("shard").to_pylist(), batch.column("contexts").to_pylist()):
                if number != shard:
                    if shard is not None:
                        yield chosen()
                    shard, sums = number, np.zeros((SHARD, width))
                keys, counts = np.frombuffer(zlib.decompress(data), "<u4").reshape(2, -1)
                np.add.at(sums.reshape(-1), keys, counts)
        if shard is not None:
            yield chosen()

    labels = np.full(buckets, UNKNOWN, np.uint8)
    dealt = texts.mapInArrow(gather, "shard int, contexts binary").repartition("shard").sortWithinPartitions("shard")
    for r in dealt.mapInArrow(choose, "shard int, labels binary").collect():  # a byte for each bucket
        labels[r.shard * SHARD : (r.shard + 1) * SHARD] = np.frombuffer(r.labels, np.uint8)
    return labels


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit: units move, the most frequent first, while the likelihood of the bigrams rises."""
    size = bigrams.sum(0) + bigrams.sum(1)
    order = np.argsort(-size, kind="stable")
    label = np.empty(len(order), np.int64)
    label[order] = np.arange(len(order)) % classes
    f = lambda x: x * np.log(np.maximum(x, 1))
    member = np.eye(classes)[label]
    table = member.T @ bigrams @ member
    every = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for u in order[: int((size > 0).sum())]:
            old, own = label[u], bigrams[u, u]
            member[u] = 0
            after, ahead = bigrams[u] @ member, bigrams[:, u] @ member  # other units' classes behind and before u
            table[old] -= after
            table[:, old] -= ahead
            table[old, old] -= own
            rows, columns = table.sum(1), table.sum(0)
            gain = (f(table + after) - f(table)).sum(1) + (f(table.T + ahead) - f(table.T)).sum(1)
            inner = table[every, every]
            gain += f(inner + after + ahead + own) - f(inner + after) - f(inner + ahead) + f(inner)
            gain -= f(rows + after.sum() + own) - f(rows) + f(columns + ahead.sum() + own) - f(columns)
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-6:
                new = int(old)
            moved += new != old
            label[u] = new
            member[u, new] = 1
            table[new] += after
            table[:, new] += ahead
            table[new, new] += own
        if not moved:
            break
    return label


@dataclass(frozen=True)
class Model:
    place: dict[bytes, int]  # of the head words, the most frequent first
    counts: np.ndarray  # of the head words
    classes: Classes
    steps: np.ndarray  # log10 P(class | class before)
    room: np.ndarray  # log10 of the denominator of P(word | class)
    tokens: int
    vocabulary: int

    def read(self, texts: list[bytes | None], head_classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
        """Tokens, known tokens, base and model score so far of each text, and its words whose counts are not in the head.

        Each missing word adds log10(count + 1) to both scores.
        """
        if not texts:
            return (np.zeros(0),) * 4 + ([],)
        tokens, starts = batch_tokens(texts)
        places = numbers_of(tokens, self.place)
        lost = np.flatnonzero(places < 0)
        rest = [tokens[i] for i in lost.tolist()]
        classes = np.zeros(len(tokens), np.int64)
        if len(head_classes):
            classes = head_classes[places]
        classes[lost] = self.classes.outside(rest)
        logs = np.where(places >= 0, np.log10(np.append(self.counts, 0) + 1.0)[places], 0.0)
        before = np.concatenate([[self.classes.of(END)], classes[:-1]])
        total = lambda x: np.add.reduceat(x, starts)
        sizes = np.diff(np.append(starts, len(tokens)))
        log, known = total(logs), total((places >= 0).astype(np.int64))
        score = log + total(self.steps[before, classes] - self.room[classes])
        cuts = np.searchsorted(lost, np.append(starts, len(tokens)))
        return sizes, known, log - sizes * np.log10(self.tokens + self.vocabulary + 1), score, [rest[a:b] for a, b in zip(cuts, cuts[1:])]

    def head_classes(self) -> np.ndarray:
        return self.classes.read(list(self.place))


def _head(counts: DataFrame) -> DataFrame:
    """The most frequent words, about HEAD; of the words of the last level of frequency, some by their hash."""
    level = F.floor(F.log2("n") * 64).cast("int")  # under 64 * 64 levels, whatever the counts
    room, least = HEAD, 0
    sizes = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    for r in sizes:
        room, least = room - r["count"], r.level
        if room <= 0:
            break
    if room >= 0:
        return counts.where(level >= least)
    at_edge = next(r["count"] for r in sizes if r.level == least)
    chosen = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int((1 << 30) * (at_edge + room) / at_edge)
    return counts.where((level > least) | ((level == least) & chosen))


def _class_sizes(counts: DataFrame, core: dict[bytes, int], buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and words of the vocabulary by ending (rows) and class (columns); the last column has words without one."""
    shared = counts.sparkSession.sparkContext.broadcast((core, np.where(buckets == UNKNOWN, CLASSES, buckets)))

    def count(batches):
        core, buckets = shared.value
        mask, sums = len(buckets) - 1, np.zeros((2, ENDINGS * (CLASSES + 1)))
        for batch in batches:
            words = batch.column("word").to_pylist()
            label = buckets[np.fromiter(map(crc32, words), np.int64, len(words)) & mask].astype(np.int64)
            own = [(i, core[w]) for i, w in enumerate(words) if w in core]
            label[[i for i, _ in own]] = [c for _, c in own]
            place = np.fromiter(map(ending_of, words), np.int64, len(words)) * (CLASSES + 1) + label
            sums[0] += np.bincount(place, batch.column("n").to_numpy(), sums.shape[1])
            sums[1] += np.bincount(place, minlength=sums.shape[1])
        used = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[0, used].astype(np.int64)), pa.array(sums[1, used].astype(np.int64))], names=["place", "tokens", "words"])

    out = np.zeros((2, ENDINGS * (CLASSES + 1)))
    for r in counts.mapInArrow(count, "place long, tokens long, words long").groupBy("place").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect():
        out[:, r.place] = r.tokens, r.words
    tokens, words = out.reshape(2, ENDINGS, CLASSES + 1)
    return tokens, words


def fit(texts: DataFrame) -> tuple[Model, DataFrame]:
    """A model of the column `text`, and the table of its word counts.

    Of words as frequent as the last of the core, the smaller in the order of
    bytes comes first.  Without texts every class and unknown word is equally
    likely.
    """
    context = texts.sparkSession.sparkContext
    counts = stored(word_counts(texts))
    head = sorted(((bytes(r.word), r.n) for r in _head(counts).collect()), key=lambda x: (-x[1], x[0]))
    place = {w: i for i, (w, _) in enumerate(head)}
    numbers = context.broadcast({w: i for i, (w, _) in enumerate(head[:CORE])})

    def core_codes():
        return lambda tokens: numbers_of(tokens, numbers.value)

    bigrams = _summed_matrix(texts, CORE, core_codes)
    label = exchange(bigrams, CLASSES)
    member = np.eye(CLASSES)[label]
    core = {w: int(label[i]) for w, i in numbers.value.items()}
    size = counts.count()
    buckets = min(max(BUCKETS[0], 1 << (PER_WORD * size).bit_length()), BUCKETS[1])
    labels = bucket_classes(texts, core, member.T @ bigrams @ member, buckets)
    # The classes of endings follow from the words that have one of their own.
    tokens, words = _class_sizes(counts, core, labels)
    usual = int(words[:, :-1].sum(0).argmax())
    endings = np.where(words[:, :-1].any(1), words[:, :-1].argmax(1), usual).astype(np.uint8)
    classes = Classes(core, labels, endings)
    shared = context.broadcast(classes)
    tokens, words = (x[:, :-1].sum(0) + np.bincount(endings, x[:, -1], CLASSES) for x in (tokens, words))

    def class_codes():
        return shared.value.read

    table = _summed_matrix(texts, CLASSES, class_codes)
    rates = (tokens + 1) / (tokens.sum() + CLASSES)
    steps = np.log10((table + PRIOR * rates) / (table.sum(1, keepdims=True) + PRIOR))
    model = Model(place, np.array([n for _, n in head], np.int64), classes, steps, np.log10(tokens + words + 1), int(tokens.sum()), size)
    return model, counts


def scored(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and log10 probabilities of each document row, learned from the rows not held out.

    `base_score` is add-one unigram, `score` the class model.  Repeated rows are
    scored alike.
    """
    text = F.col(text_col).cast("string")
    model, counts = fit(docs.where(~held_out).select(text.alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), text.alias("text"))
    schema = T.StructType([T.StructField("key", T.LongType()), source.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
                           *[T.StructField(k, T.LongType()) for k in ("n_tokens", "n_known")],
                           *[T.StructField(k, T.DoubleType()) for k in ("base", "model")],
                           T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.LongType()))])

    def read(batches):
        model, key = shared.value, TaskContext.get().partitionId() << 40
        head = model.head_classes()
        for batch in batches:
            *numbers, lost = model.read(texts_of(batch.column("text")), head)
            rest = [Counter(words) for words in lost]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(key, key + len(rest))), batch.column("doc_id"), batch.column("held_out"), *[pa.array(x, k) for x, k in zip(numbers, kinds)],
                 pa.array([list(c) for c in rest], pa.list_(pa.binary())), pa.array([list(c.values()) for c in rest], pa.list_(pa.int64()))],
                names=schema.names,
            )
            key += len(rest)

    found = stored(source.mapInArrow(read, schema))
    parts = F.struct("doc_id", "held_out", "n_tokens", "n_known", "base", "model")
    rest = found.select("key", F.explode(F.arrays_zip("words", "times")).alias("x")).select("key", F.col("x.words").alias("word"), F.col("x.times").alias("k"))
    rest = rest.join(counts, "word").select("key", F.lit(None).cast(found.select(parts).schema[0].dataType).alias("doc"), "k", (F.col("k") * F.log10(F.col("n") + 1)).alias("log"))
    whole = found.select("key", parts.alias("doc"), F.lit(0).cast("bigint").alias("k"), F.lit(0.0).alias("log")).union(rest)
    out = whole.groupBy("key").agg(F.max("doc").alias("doc"), F.sum("k").alias("k"), F.sum("log").alias("log"))
    return out.select(
        "doc.doc_id", "doc.held_out", "doc.n_tokens", (F.col("doc.n_known") + F.col("k")).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("doc.base") + F.col("log")).alias("base_score"), (F.col("doc.model") + F.col("log")).alias("score"),
    )
