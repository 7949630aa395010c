"""Jaccard join, packing, language model and nearest neighbours against brute force."""

import math
import random
import re
import time
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.llm import classlm, jaccard, multi_index, packing
from lattica.llm.common import stored_alone
from lattica.llm.components import components
from lattica.llm.queries import added_tokens, tokenizer
from lattica.llm.shingles import Hasher

ASCII = {i: i + 32 for i in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = SPACED.findall((text or "").translate(ASCII))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def varied_texts(seed, n):
    """Chains of edits, short texts, hot passages and copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=30)
    texts = []
    while len(texts) < n:
        words = rng.choices(vocabulary, k=rng.choice([1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 20, 40, 80, 160]))
        if rng.random() < 0.3:
            words = words[: len(words) // 3] + passage + words[len(words) // 3 :]
        for _ in range(rng.choice([1, 1, 3, 6])):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                words = words or ["left"]
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [words[k], "NEW"]])
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_texts(spark, seed):
    texts = varied_texts(seed, 260) + [None, "", "  \n", "one", "ONE", "one two", "x" * 50_000, "y " * 20_000]
    rows = list(enumerate(texts, 10)) + [(12, texts[2])]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, class int, size int").repartition(5)
    got = jaccard.near_duplicates(docs).collect()
    want = plain_components(rows)
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, want[i]) for i, _ in rows)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(shingles(t))) for i, t in rows)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in want if want[i] == i}


def test_near_copies_beyond_the_pivots(spark):
    rng = random.Random(3)
    body = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(150):  # edits that put pairs on both sides of the threshold
        words = list(body)
        for k in rng.sample(range(120), rng.randrange(0, 7)):
            words[k] = f"e{i}x{k}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_components(list(enumerate(texts)))
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == want
    assert len(set(want.values())) > 1


def test_small_tables_take_few_tasks(spark):
    rng = random.Random(3)
    rows = []
    for group in range(6):  # chains of near copies, whose ends do not link
        words = [f"g{group}w{i}" for i in range(60)]
        for k in range(25):
            rows.append((len(rows), " ".join(words)))
            words[rng.randrange(60)] = f"new{group}x{k}"
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    for key, value in zip(before, ("40", "false")):
        spark.conf.set(key, value)
    context.setJobGroup("few tasks", "near duplicates")
    try:
        got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        stages = {s for j in tracker.getJobIdsForGroup("few tasks") for s in tracker.getJobInfo(j).stageIds}
        wide = sum(info.numTasks >= 40 for s in stages if (info := tracker.getStageInfo(s)))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == plain_components(rows)
    assert wide <= 14  # 21 before the turns knew their rows


def test_jaccard_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (None, None), (None, "q r s t u v")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {(None, 2, 5), (5, 2, 5), (None, 0, None), (None, 2, None)}
    assert jaccard.keep_one(docs).count() == 4
    assert jaccard.near_duplicates(docs.limit(0)).collect() == []
    copies = spark.createDataFrame([(i, "same text again") for i in range(40)], "doc_id long, text string")
    assert {r.component_id for r in jaccard.near_duplicates(copies).collect()} == {0}


@given(st.lists(st.integers(1, 40), min_size=1, max_size=12, unique=True), st.lists(st.integers(1, 40), min_size=1, max_size=12, unique=True))
@settings(max_examples=200, deadline=None)
def test_bounds_never_hide_a_link(x, y):
    a, b = np.array(sorted(x), np.uint64), np.array(sorted(y), np.uint64)
    both = len(set(x) & set(y))
    assert (100 * both >= 75 * (len(a) + len(b) - both)) == (both >= jaccard.common(len(a), len(b)))
    if both >= jaccard.common(len(a), len(b)):
        assert len(b) in jaccard.partners(len(a), 100)
        differ = sum(int(p ^ q).bit_count() for p, q in zip(jaccard._parities(a).view(np.uint64), jaccard._parities(b).view(np.uint64)))
        assert differ <= len(a) + len(b) - 2 * both


def test_counters_survive_packing():
    rng = np.random.default_rng(1)
    for share in (0, 1e-4, 0.1, 0.5, 1):
        counts = np.where(rng.random(jaccard.CHUNK) < share, rng.integers(1, 256, jaccard.CHUNK), 0).astype(np.uint8)
        assert (jaccard._unpacked(jaccard._packed(counts)) == counts).all()


def test_sparse_counters_pack_small():
    counts = np.random.default_rng(2).poisson(0.5, jaccard.CHUNK).astype(np.uint8)
    assert len(jaccard._packed(counts)) < jaccard.CHUNK / 4


def test_sets_are_not_shuffled_to_find_copies(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(i, text) for i in range(8)] + [(8, text + " more")], "doc_id long, text string").repartition(4)
    classes = jaccard._first_pass(docs, "doc_id", "text").where("size > 0").select("class").distinct()
    sets = jaccard._wanted_sets(docs, "text", classes)
    assert sets.count() > sets.select("class").distinct().count() == 2
    a, b = sorted(r["class"] for r in classes.collect())
    pairs = spark.createDataFrame([(a, b)], "a long, b long")
    assert [tuple(r) for r in jaccard._verified(pairs, sets).collect()] == [(a, b)]


POSTING = "token long, class long, meta long, hot boolean, kind byte"


def test_lists_are_made_by_one_shuffle(spark, monkeypatch):
    size = 20 << 32
    rows = [(1, 10, size, False, 0), (1, 10, size, False, 0), (1, 11, size, False, 0), (1, 10, size, False, 1), (2, 10, size, False, 0), (2, 10, size, False, 0)]
    rows += [(3, 10, size, True, 0), (3, 10, size, True, 0), (3, 11, size, True, 0), (4, 10, size, False, 1), (4, 10, size, False, 1), (4, 11, size, False, 1)]
    plans, write = [], jaccard.stored_alone
    monkeypatch.setattr(jaccard, "stored_alone", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    lists = jaccard._shared_lists(spark.createDataFrame(rows, POSTING))
    assert len(plans) == 1 and plans[0].count("Exchange ") == 1
    got = sorted((r.token, r.kind, r.hot, sorted(tuple(m) for m in r.members)) for r in lists.collect())
    assert got == [(1, 0, False, [(10, size), (11, size)]), (3, 0, True, [(10, size)]), (3, 0, True, [(11, size)]), (4, 1, False, [(10, size)]), (4, 1, False, [(11, size)])]


def test_lists_in_rows_pair_as_lists_of_rows(spark):
    rng = random.Random(4)
    rows = {(t, c): (t, c, rng.randrange(20, 30) << 32 | rng.randrange(8)) for t in range(12) for c in rng.sample(range(-50, 50), 3 * t + 2)}.values()
    lists = jaccard._shared_lists(spark.createDataFrame([(*r, False, 0) for r in rows], POSTING))
    assert sorted(tuple(r) for r in jaccard._members(lists).collect()) == sorted(rows)
    for turn in (1, 2):
        want = sorted(tuple(r) for r in jaccard._by_pivots(spark.createDataFrame(list(rows), "token long, class long, meta long"), turn).collect())
        assert sorted(tuple(r) for r in jaccard._within(lists, turn).collect()) == want and len(want) > 50


def test_counts_cut_off_make_long_lists(spark):
    docs = spark.createDataFrame([(i, f"an often used line {i}x more {i}") for i in range(300)], "doc_id long, text string").coalesce(1)
    order = jaccard._order(jaccard._first_pass(docs.selectExpr("doc_id", "concat('one common start of all texts ', text) AS text"), "doc_id", "text"))
    shared, own = (next(jaccard.Hasher().sets([t])) for t in (b"one common start of all", b"a text of its own"))
    assert order.prefix(shared, 1)[1].tolist() == [True]
    assert order.prefix(own, 1)[1].tolist() == [False]


def test_shuffles_leave_the_disk_when_their_table_is_written(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = shuffles()
    table = stored_alone(spark.range(1000).repartition(3, "id"))
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before and table.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_boundary_follows_cost():
    assert jaccard.boundary({}) == 0
    assert jaccard.boundary({2: 1000, 3: 1000}) >= 3
    assert jaccard.boundary({10: 1000}) < 10


def test_components_of_a_chain(spark):
    n = 60
    rng = random.Random(1)
    names = rng.sample(range(1000), n)
    links = [(names[i], names[i + 1]) for i in range(n - 1)] + [(2000, 2001), (2001, 2000), (3000, 3000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(names, min(names)), 2000: 2000, 2001: 2000}


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_shingle_counts(text):
    assert len(next(Hasher().sets([text.encode("utf-8", "ignore")]))) == len(shingles(text.encode("utf-8", "ignore").decode()))


@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50), max_size=12))
@settings(max_examples=200, deadline=None)
def test_plan_is_gapless(counts):
    slots, sequences = packing.plan(counts, 32)
    rows = []
    for n, c in counts.items():
        s = slots[n]
        for rank in range(c):
            at = np.searchsorted(s.low, rank, "right") - 1
            rows.append((int(s.sequence[at] + rank - s.low[at]), int(s.offset[at]), n))
    ends = defaultdict(int)
    for sequence, offset, n in sorted(rows):
        assert offset == ends[sequence]
        ends[sequence] += n
    assert len(ends) == sequences and all(e <= 32 for e in ends.values())
    total = sum(n * c for n, c in counts.items())
    assert sequences <= 2 * max(1, math.ceil(total / 32))


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    ranks = tokenizer()
    reader = Tokenizer.from_file(re.sub(r"\.tiktoken$", ".json", ranks["ranks_path"]))
    reader.encode_special_tokens = True
    texts = [None, "", "a", "a", "it's  the\n\n <|endoftext|> end", "émigré 😀 \t x", "word " * 1023, "word " * 5000, "ab" * 30_000, "　   ǆ १२३ x1y2"]
    texts += [f"text number {i} " * (i % 40) for i in range(80)]
    docs = spark.createDataFrame([(i, t, 4) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(3)
    got = packing.pack(docs, **ranks).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = np.array([*reader.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert [(r.piece, r.start, r.length) for r in sorted(pieces[i], key=lambda r: r.piece)] == [(k, s, n) for k, (s, n) in enumerate(packing.cut(len(ids)))]
        assert all(r.ids_crc32 == crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces[i])
        assert len(pieces[i]) == max(1, math.ceil(len(ids) / 1024))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(sequences) <= math.ceil(total / 1024) + 1
    assert packing.pack(docs.limit(0), **ranks).collect() == []


def test_packing_reads_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from lattica.llm.queries import op9_packing

    reader = Tokenizer.from_file(re.sub(r"\.tiktoken$", ".json", tokenizer()["ranks_path"]))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y", "<|endoftext|", "<|ENDOFTEXT|>", " <|endoftext|>  ", "plain", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in enumerate(texts):
        ids = np.array([*reader.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (len(ids), crc32(ids.tobytes()))
    assert reader.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    assert {r.doc_id: (r.length, r.ids_crc32) for r in op9_packing(spark, str(tmp_path)).collect()} == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: (r.length, r.ids_crc32) for r in corpus_pipeline.packed_sequences(spark, docs, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("run", [" " * 10**6, "\n" * 10**6, "\t \n\u3000" * 250_001, " " * 10**7, "\r\n" * 9_999, " " * 9_999])
def test_long_white_space(run):
    """The tokenizer itself on runs it can take in reasonable time; shorter runs follow the same rules."""
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(re.sub(r"\.tiktoken$", ".json", tokenizer()["ranks_path"]))
    encode = packing.encoder(**tokenizer(), special=added_tokens())
    # The engine of the pattern gives up on a run of a million, that of the tokenizer does not.
    for text in (run + "word", "a b" + run + "<|endoftext|>" + run[:20_000] + "!  x", "x" + run[:20_001], run[:20_000] + "<|endoftext|"):
        if len(run) <= 10**6 or text.startswith(run):
            assert encode(text).tolist() == [*reader.encode(text, add_special_tokens=False).ids, 2]


def lm_tokens(text):
    return SPACED.findall((text or "").translate(ASCII)) + ["\n"]


def plain_model(texts, classes):
    """log10 transitions and class denominators, recounted from the texts under given classes of words."""
    counts = Counter(w for t in texts for w in lm_tokens(t))
    steps = Counter((a, b) for t in texts for a, b in zip([classes("\n"), *map(classes, lm_tokens(t))], map(classes, lm_tokens(t))))
    k = classlm.CLASSES
    tokens, words, behind = Counter(), Counter(), Counter()
    for w, n in counts.items():
        tokens[classes(w)] += n
        words[classes(w)] += 1
    for (a, _), n in steps.items():
        behind[a] += n
    total = sum(counts.values())
    rate = {c: (tokens[c] + 1) / (total + k) for c in range(k)}
    step = lambda a, b: math.log10((steps[a, b] + classlm.PRIOR * rate[b]) / (behind[a] + classlm.PRIOR))
    room = {c: math.log10(tokens[c] + words[c] + 1) for c in range(k)}
    return counts, step, room


def zipf_texts(seed=2):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices([f"Word{i}" for i in range(3000)], weights=[1 / (i + 1) for i in range(3000)], k=rng.randrange(80))) for _ in range(120)]
    return texts + [None, "", "unseen çà", "unseen çà", "z" * 40_000, texts[3]]


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(classlm, "HEAD", 300)
    monkeypatch.setattr(classlm, "CORE", 60)
    monkeypatch.setattr(classlm, "CLASSES", 8)
    texts = zipf_texts()
    rows = [(i, t, 0.5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(4)
    held = F.col("doc_id") % 3 == 0
    model, table = classlm.fit(docs.where(~held).select("text"))
    classes = lambda w: model.classes.of(w.encode())
    trained = [t for i, t in enumerate(texts) if i % 3]
    counts, step, room = plain_model(trained, classes)
    assert {bytes(r.word).decode(): r.n for r in table.collect()} == dict(counts)
    assert len(model.classes.core) == 60 and 200 < len(model.place) < 400
    n, v = sum(counts.values()), len(counts)
    for r in classlm.scored(docs, held).collect():
        words = lm_tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words), sum(counts[w] > 0 for w in words), n, r.doc_id % 3 == 0)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
        before, want = classes("\n"), 0.0
        for w in words:
            want += step(before, classes(w)) + math.log10(counts[w] + 1) - room[classes(w)]
            before = classes(w)
        assert r.score == pytest.approx(want, rel=1e-9)
    # From any class, all known words and one unknown word of each class share a probability of one.
    for a in range(8):
        inside = sum(10 ** step(a, classes(w)) * (c + 1) / 10 ** room[classes(w)] for w, c in counts.items())
        assert inside + sum(10 ** (step(a, b) - room[b]) for b in range(8)) == pytest.approx(1, rel=1e-9)


def test_every_training_word_gets_a_class_by_its_neighbours(spark, monkeypatch):
    monkeypatch.setattr(classlm, "CORE", 60)
    monkeypatch.setattr(classlm, "CLASSES", 8)
    texts = zipf_texts(3)
    model, _ = classlm.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    core, mask = model.classes.core, len(model.classes.buckets) - 1
    bigrams, contexts = np.zeros((8, 8)), defaultdict(lambda: np.zeros(16))
    for t in texts:
        words = [w.encode() for w in lm_tokens(t)]
        for a, b in zip([b"\n", *words], words):
            if a in core and b in core:
                bigrams[core[a], core[b]] += 1
            elif b in core:
                contexts[crc32(a) & mask][core[b]] += 1
            elif a in core:
                contexts[crc32(b) & mask][8 + core[a]] += 1
    smooth = bigrams + 0.1
    gain = np.log(smooth * smooth.sum() / np.outer(smooth.sum(1), smooth.sum(0)))
    assert len(contexts) > 900
    for bucket, seen in contexts.items():
        scores = [sum(seen[:8] * gain[c]) + sum(seen[8:] * gain[:, c]) for c in range(8)]
        assert scores[model.classes.buckets[bucket]] == pytest.approx(max(scores), abs=1e-9)
    assert set(np.flatnonzero(model.classes.buckets != classlm.UNKNOWN)) == set(contexts)
    assert all(model.classes.of(w.encode()) < 8 for t in [*texts, "never seen"] for w in lm_tokens(t))


def test_head_of_one_frequency_is_never_empty(spark, monkeypatch):
    monkeypatch.setattr(classlm, "HEAD", 400)
    counts = spark.range(4000).select(F.col("id").cast("string").cast("binary").alias("word"), F.when(F.col("id") < 50, 9).otherwise(2).cast("bigint").alias("n"))
    head = classlm._head(counts)
    assert head.where("n = 9").count() == 50 and 250 < head.count() < 550


def test_language_model_without_training(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in classlm.scored(docs, F.lit(True)).collect()}
    assert rows[1].n_tokens == 3 and rows[1].n_known == 0 and rows[1].base_score == 0 and rows[1].score < 0 and rows[2].n_tokens == 1
    assert classlm.scored(docs.limit(0), F.lit(False)).collect() == []


def test_exchange_groups_words_of_like_context():
    # Words 0-9 are followed by 10-19 and the other way round.
    rng = np.random.default_rng(1)
    bigrams = np.zeros((20, 20))
    for a in range(10):
        for b in range(10, 20):
            bigrams[a, b], bigrams[b, a] = rng.integers(5, 15, 2)
    label = classlm.exchange(bigrams, classes=2)
    assert len(set(label[:10])) == 1 and len(set(label[10:])) == 1 and label[0] != label[10]


def plain_nearest(rows, q, v, k):
    scores = [(-(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), i) for i, w in rows if i != q]
    return sorted(scores)[:k]


def test_nearest(spark):
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(size=16).astype(np.float32) for i in range(400)}
    hot = rng.normal(size=16).astype(np.float32)
    vectors.update({i: hot for i in range(400, 480)})  # ties
    rows = [(i, v.tolist(), 1.5) for i, v in vectors.items()]
    odd = [(1000, None, 0.0), (1001, [0.0] * 16, 0.0), (1002, [float("nan")] + [1.0] * 15, 0.0), (1003, [float("inf")] + [1.0] * 15, 0.0),
           (1004, [None] + [1.0] * 15, 0.0), (1005, [1.0] * 4, 0.0), (None, [1.0] * 16, 0.0), (7, vectors[7].tolist(), 0.0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score double").repartition(4)
    got = defaultdict(list)
    for r in multi_index.search(table, F.col("id") % 10 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 480, 10))
    found = wanted = 0
    plain = [(i, v.astype(float)) for i, v in vectors.items()]
    for q, hits in got.items():
        best = plain_nearest(plain, q, vectors[q].astype(float), 5)
        hits.sort()
        assert [h[0] for h in hits] == [1, 2, 3, 4, 5]
        assert [(-s, i) for _, i, s in hits] == sorted((-s, i) for _, i, s in hits)
        for _, i, s in hits:
            v, w = vectors[q].astype(float), vectors[i].astype(float)
            assert s == pytest.approx(v @ w / (np.linalg.norm(v) * np.linalg.norm(w)), abs=1e-12)
        found += len({i for _, i in best} & {h[1] for h in hits})
        wanted += 5
        if q >= 400:
            assert [h[1] for h in hits] == [i for _, i in best]
    assert found / wanted >= 0.9


def test_queries_score_visited_cells_only(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16)) * 4
    x = np.vstack([c + rng.normal(size=(40, 16)) for c in centres])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    entries = multi_index.usable(table, "vec_id", "embedding")
    quantiser, total = multi_index.fit(entries, 5)
    units = x / np.linalg.norm(x, axis=1)[:, None]
    a, b = (d.argmin(1) for d in quantiser.halves(units))
    counts = np.zeros((len(quantiser.first), len(quantiser.second)), np.int64)
    np.add.at(counts, (a, b), 1)
    wanted = max(math.ceil(quantiser.share * total), multi_index.LEAST * 6)
    asked = x[::10]
    limits = np.array([multi_index.reach(p, q, counts, wanted) for p, q in zip(*quantiser.halves(units[::10]))])
    assert multi_index.visited_share(quantiser, counts, asked, limits) < 0.3
    found = {(r.query_id, r.vec_id) for r in multi_index.search(table, F.col("id") % 10 == 0).collect()}
    best = {(q, i) for q in range(0, len(x), 10) for _, i in plain_nearest(list(enumerate(x)), q, x[q], 5)}
    assert len(found & best) / len(best) >= 0.9


def test_cells_of_sorted_rows():
    cells = list(multi_index.cells_of(np.array([0, 0, 0, 1, 1]), np.array([2, 2, 3, 3, 3])))
    assert cells == [(0, 2, slice(0, 2)), (0, 3, slice(2, 3)), (1, 3, slice(3, 5))]


def test_few_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.1])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in multi_index.search(table, F.col("id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 1)]
    assert multi_index.search(table.limit(0), F.col("id") == 0).collect() == []
    assert multi_index.search(table.where("vec_id = 0"), F.col("id") == 0).collect() == []
    assert multi_index.search(table, F.col("id") == 9).collect() == []


def test_heap_visits_cells_in_order():
    rng = np.random.default_rng(6)
    for wanted in (1, 7, 40, 10_000):
        a, b, counts = rng.random(9), rng.random(7), rng.integers(0, 4, (9, 7))
        limit = multi_index.reach(a, b, counts, wanted)
        sums = (a[:, None] + b).ravel()
        order = np.argsort(sums)
        enough = np.searchsorted(counts.ravel()[order].cumsum(), wanted)
        assert limit == pytest.approx(sums[order][min(enough, len(order) - 1)])


