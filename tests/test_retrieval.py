import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import answers, fusion, inverted_index, keyword_search, scoring, vectors
from lattica.operators.fusion import RetrievalConfig


def _random_vectors(spark, n, width, seed, key):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=width)]) for i in range(n)]
    return spark.createDataFrame(rows, f"{key} long, payload array<double>"), np.array([v for _, v in rows])


def test_search_equals_brute_force_in_blocks(spark):
    items, a = _random_vectors(spark, 300, 8, 1, "item_id")
    asked, b = _random_vectors(spark, 25, 8, 2, "request_id")
    sims = np.round((b / np.linalg.norm(b, axis=1, keepdims=True)) @ (a / np.linalg.norm(a, axis=1, keepdims=True)).T, 12)
    expected = {(q, int(i), r + 1) for q in range(25) for r, i in enumerate(np.lexsort((np.arange(300), -sims[q]))[:7])}
    scan = scoring.top_matches(items, asked, scoring.cosine_kernel(), 7)
    blocks = scoring.top_matches(items, asked, scoring.cosine_kernel(), 7, block_bytes=1000)
    for found in (scan, blocks):
        assert {(r.request_id, r.item_id, r["rank"]) for r in found.collect()} == expected


def test_ties_are_broken_by_id_across_tasks(spark):
    items = spark.range(2000).select(F.col("id").alias("item_id"), F.lit("same words here").alias("payload")).repartition(4)
    asked = spark.createDataFrame([(1, "words here"), (2, "nothing")], "request_id long, question string")
    found = keyword_search.search(items.withColumnRenamed("payload", "text"), asked, 5, id_column="item_id", carry="text")
    assert [(r.request_id, r.item_id, r.text) for r in found.orderBy("rank").collect()] == [(1, i, "same words here") for i in range(5)]


def test_substring_kernel_with_string_ids(spark):
    items = spark.createDataFrame([("b", "alpha beta"), ("a", "beta"), ("c", None)], "item_id string, payload string")
    asked = spark.createDataFrame([(1, ["alpha", "beta"])], "request_id long, payload array<string>")
    found = scoring.top_matches(items, asked, scoring.containment_kernel(), 5).orderBy("rank").collect()
    assert [(r.item_id, r.score) for r in found] == [("b", 2.0), ("a", 1.0)]


def test_min_score_and_filter(spark):
    table = spark.createDataFrame([(1, 10, [1.0, 0.0]), (2, 11, [0.0, 1.0]), (3, 12, [1.0, 1.0])], "vec_id long, document_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "request_id long, vector array<double>")
    ids = lambda df: [r.item_id for r in df.orderBy("rank").collect()]
    assert ids(vectors.search(table, asked, 5, min_score=0.5)) == [1, 3]
    only = spark.createDataFrame([(11,), (12,)], "document_id long")
    assert ids(vectors.search(table, asked, 5, document_filter=only)) == [3, 2]


def test_embedding_is_stable_and_shared(spark):
    df = spark.createDataFrame([(1, "A b a"), (2, "a B A"), (3, "")], "id long, text string")
    rows = {r.id: r.vector for r in vectors.embed_distinct(df, "text", vectors.HashingEmbedder(16)).collect()}
    assert rows[1] == rows[2] and sum(abs(x) for x in rows[1]) == 3.0 and not any(rows[3])


HITS = "request_id long, result_type string, hit_id string, content string, score double"


def test_fusion_scores(spark):
    hits = [(1, kind, "x", "same", 0.9) for kind in ("vector", "graph", "keyword")] + [(2, "vector", "a", "one", 0.9), (3, "graph", "a", "one", 0.9), (4, "keyword", "a", "one", 0.9)]
    rows = {r.request_id: r for r in fusion.fuse(spark.createDataFrame(hits, HITS)).collect()}
    assert rows[1].score == pytest.approx(3.3 / 61, abs=1e-9) and rows[1].result_type == "vector"
    assert [rows[i].score for i in (2, 3, 4)] == pytest.approx([1 / 61, 1.5 / 61, 0.8 / 61], abs=1e-9)


def test_fusion_groups_by_leading_characters(spark):
    hits = [(1, "vector", "a", "p" * 100 + "x", 0.9), (1, "vector", "b", "p" * 100 + "y", 0.8), (1, "keyword", "c", "other", 0.1), (1, "vector", "d", "nan", float("nan"))]
    whole = fusion.fuse(spark.createDataFrame(hits, HITS)).orderBy("rank").collect()
    assert [r.hit_id for r in whole] == ["a", "b", "c"]
    rows = fusion.fuse(spark.createDataFrame(hits, HITS), RetrievalConfig(final_top_k=5, content_key_chars=100)).orderBy("rank").collect()
    assert [r.hit_id for r in rows] == ["a", "c"]
    assert rows[0].score == pytest.approx(1 / 61 + 1 / 62, abs=1e-9)
    assert fusion.confidence(spark.createDataFrame([(1, 0.05), (1, 0.03), (2, 0.5)], "request_id long, score double")).orderBy("request_id").collect()[1].confidence == 1.0


def test_packing_stops_at_the_budget(spark):
    results = spark.createDataFrame([(1, 1, "a" * 5), (1, 2, "é" * 3), (1, 3, "b")], "request_id long, rank long, content string")
    packed = fusion.pack_context(results, ["request_id"], [F.col("rank")], budget=10)
    assert [r["rank"] for r in packed.collect()] == [1]


@pytest.mark.parametrize(
    "question, expected",
    [("휴가 신청은 어떻게 하나요", "procedural"), ("Show me", "procedural"), ("A vs B", "comparative"), ("What is leave?", "definitional"),
     ("연차는 며칠인가요", "factual"), ("different rules", "conditional"), ("hello", "general")],
)
def test_intents(one, question, expected):
    assert one(answers.intent(F.lit(question))) == expected


def test_prompt_parts(one):
    built = one(answers.build_prompt(F.lit("sys"), F.array(F.lit("c1"), F.lit("c2")), F.lit("q?"), F.array(F.lit("i1"), F.lit("i2"))))
    assert built == "<s>\nsys\n</s>\n\n<context>\nc1\n\nc2\n\n</context>\n\n<question>\nq?\n</question>\n\n<instructions>\n1. i1\n2. i2\n</instructions>\n"
    empty = F.array().cast("array<string>")
    assert one(answers.build_prompt(F.lit(""), empty, F.lit(""), empty)) == ""


def test_answers_and_citations(spark):
    asked = spark.createDataFrame([(1, "q1"), (2, "q2")], "request_id long, question string")
    results = spark.createDataFrame([(1, 1, "d1", "text one"), (1, 2, "d2", "text two")], "request_id long, rank long, source string, content string")
    prompts = {r.request_id: r.prompt for r in answers.assemble_prompts(asked, results, ontology="schema\n").collect()}
    assert "[1] 출처: d1\ntext one\n\n[2] 출처: d2" in prompts[1] and "온톨로지" in prompts[1] and "<context>\n</context>" in prompts[2]
    said = spark.createDataFrame([(1, "x [출처: 2] y [출처:1] z [출처: 2] [출처: 9] [출처: 0]")], "request_id long, answer string")
    assert [r.citation for r in answers.citations(said, results).orderBy("citation").collect()] == [1, 2]

    class Model:
        def generate_batch(self, prompts):
            if "q2" in prompts[0]:
                raise RuntimeError("down")
            return ["fine"]

    made = {r.request_id: r for r in answers.generate(answers.assemble_prompts(asked, results), Model()).collect()}
    assert made[1].answer == "fine" and made[2].answer is None and made[2].error == "down"


def _worded(spark, n=1500):
    """Texts whose topic changes slowly along the table, a few odd ones, and requests."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(n):
        topic = words[(i // 150) * 30 : (i // 150) * 30 + 30]
        texts.append((i, " ".join(rng.choice(topic + words[:5], rng.integers(1, 40)))))
    texts += [(n, None), (n + 1, ""), (n + 2, "W7\u00a0w7\tW7 w8"), (n + 3, "w7 " * 5000), (n + 4, "w7 " * 5000)]
    asked = [(k, sorted({str(w) for w in rng.choice(words, rng.integers(1, 6))})) for k in range(40)] + [(90, []), (91, ["nowhere"]), (92, ["w7"])]
    items = spark.createDataFrame(texts, "doc_id long, text string").repartition(4).sortWithinPartitions("doc_id")
    return items, spark.createDataFrame(asked, "request_id long, payload array<string>"), texts, asked


def _plain_hits(texts, asked, k):
    out = set()
    for request, terms in asked:
        scored = []
        for i, text in texts:
            words = (text or "").lower().split()
            score = round(sum(words.count(t) / (words.count(t) + 1.2) for t in terms) / max(len(terms), 1), 12)
            if score > 0:
                scored.append((-score, i))
        out |= {(request, i, round(-s, 9), rank) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def test_postings_give_what_counting_gives(spark, tmp_path):
    items, requests, texts, asked = _worded(spark)
    folder = f"{tmp_path}/index"
    inverted_index.write(items, folder)
    index = inverted_index.read(spark, folder)
    want = _plain_hits(texts, asked, 7)
    for found in (
        inverted_index.search(items, requests, 7),
        inverted_index.search(items, requests, 7, index=index),
        inverted_index.search(items, requests, 7, index=index, block_bytes=500),
    ):
        assert {(r.request_id, r.item_id, round(r.score, 9), r["rank"]) for r in found.collect()} == want
    carried = inverted_index.search(items, requests, 7, carry="text", index=index, min_score=0.3).collect()
    assert carried and all(r.score >= 0.3 and dict(texts)[r.item_id] == r.text for r in carried)


def test_index_opens_few_blocks_and_runs_no_python(spark, tmp_path):
    items, requests, _, asked = _worded(spark)
    folder = f"{tmp_path}/index"
    inverted_index.write(items, folder)
    index = inverted_index.read(spark, folder)
    assert index.groupBy("term", "block").count().where("count > 1").isEmpty()
    assert index.selectExpr("max(size(entries)) AS n").first().n <= inverted_index.PER_BLOCK
    spread = inverted_index.Asked.of(spark, "long", [i for i, _ in asked], [ts for _, ts in asked])
    bounds, near = inverted_index.candidate_blocks(index, spread, 3)
    assert near.count() < 0.7 * bounds.count()
    for given in (None, index):
        plan = inverted_index.search(items, requests, 3, index=given)._jdf.queryExecution().executedPlan().toString()
        assert "InArrow" not in plan and "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_index_of_nothing(spark, tmp_path):
    items, requests, _, _ = _worded(spark, 3)
    for given in (items.limit(0), items):
        folder = f"{tmp_path}/{given.count()}"
        inverted_index.write(given, folder)
        index = spark.read.schema("term string, block long, most long, entries array<struct<item_id:long,n:long>>, folder int").parquet(folder)
        assert inverted_index.search(given, requests.limit(0), 3, index=index).collect() == []
        if given is not items:
            assert inverted_index.search(given, requests, 3).collect() == inverted_index.search(given, requests, 3, index=index).collect() == []


def test_a_fourth_search_joins_and_hits_know_their_place(spark):
    from lattica.functions.access import Principal
    from lattica.plans import retrieval

    chunks = spark.createDataFrame(
        [("1:0", 1, 4, "Leave", "annual leave takes fifteen days", "public", None, None, [], []), ("2:0", 2, None, None, "sick leave needs a note", "internal", None, None, [], [])],
        "chunk_id string, document_id long, page int, section string, content string, access_level string, owner_id string, department string, required_roles array<string>, allowed_users array<string>",
    )
    nodes = spark.createDataFrame([("n1", "Rule", "annual leave", {"text": "annual leave"}, 0.9)], "node_id string, class string, text string, properties map<string,string>, confidence double")
    edges = spark.createDataFrame([], "src string, predicate string, dst string, confidence double")
    asked = spark.createDataFrame([(1, "annual leave")], "request_id long, question string")

    class Pinned:
        name, weight = "pinned", 3.0

        def search(self, questions):
            return questions.select("request_id", F.lit("p").alias("hit_id"), F.lit("pinned answer").alias("content"), F.lit(1.0).alias("score"))

    rows = retrieval.retrieve(asked, chunks, nodes, edges, Principal("guest"), more=[Pinned()]).orderBy("rank").collect()
    assert [r.hit_id for r in rows][:1] == ["p"] and {r.hit_id for r in rows} == {"p", "1:0", "n1"}
    places = {r.hit_id: r.place for r in rows}
    assert tuple(places["1:0"]) == (1, 4, "Leave") and places["p"] is None and places["n1"] is None
    only = retrieval.retrieve_from(asked, [retrieval.KeywordBackend(chunks, weight=1.0)]).collect()
    assert {r.hit_id for r in only} == {"1:0", "2:0"} and {r.result_type for r in only} == {"keyword"}


def test_ranking_quality(spark):
    from lattica.operators import evaluation

    judged = spark.createDataFrame([(1, 10, 1.0), (1, 11, 0.5), (1, 12, 0.25), (2, 20, 1.0), (3, 30, 1.0)], "request_id long, document_id long, gain double")
    listed = spark.createDataFrame([(1, 11, 1), (1, 99, 2), (1, 10, 3), (1, 11, 4), (2, 21, 1), (4, 40, 1), (3, 30, 6)], "request_id long, document_id long, rank int")
    rows = {r.request_id: r for r in evaluation.ranking_quality(listed, judged, k=5).collect()}
    ideal = 1 + 0.5 / np.log2(3) + 0.25 / 2
    assert set(rows) == {1, 2, 3} and (rows[1].relevant, rows[1].found, rows[1].recall, rows[1].reciprocal_rank) == (3, 2, pytest.approx(2 / 3), 1.0)
    assert rows[1].ndcg == pytest.approx((0.5 + 1 / 2) / ideal)
    assert [(rows[i].found, rows[i].recall, rows[i].ndcg) for i in (2, 3)] == [(0, 0.0, 0.0)] * 2


def test_held_passages(spark):
    from lattica.operators import evaluation

    docs = spark.createDataFrame([(1, "x A b\nc d e y"), (2, "a b c"), (3, None), (4, "b c d e f")], "document_id long, text string")
    items = spark.createDataFrame([(7, "a b c d e"), (8, "B  c"), (9, ""), (10, None)], "request_id long, text string")
    rows = {(r.request_id, r.document_id): r.gain for r in evaluation.held_passages(docs, items, window=3).collect()}
    assert rows == {(7, 1): 1.0, (7, 2): pytest.approx(1 / 3), (7, 4): pytest.approx(2 / 3), (8, 1): 1.0, (8, 2): 1.0, (8, 4): 1.0}


def test_tasks_of_a_keyword_search_hold_few_pairs(spark, monkeypatch):
    """Numbers are dealt by the pairs they become, not by their bytes, and hits stay the same."""
    items, requests, texts, asked = _worded(spark)
    monkeypatch.setattr(inverted_index, "PAIRS", 5000)
    found = inverted_index.search(items, requests, 7)
    tasks = inverted_index.tasks_for(len(texts), len(asked))
    assert tasks == len(texts) * len(asked) // 5000 + 1
    assert "Exchange hashpartitioning(item_id" in found._jdf.queryExecution().executedPlan().toString()
    assert f", {tasks}), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.request_id, r.item_id, round(r.score, 9), r["rank"]) for r in found.collect()} == _plain_hits(texts, asked, 7)


def test_index_is_written_with_one_shuffle(spark, tmp_path):
    """Lists are made where a block is read; words end where `terms_of` ends them, and an item counts once in a block."""
    texts = [(2, "B a\u2003b\x1cc"), (1, "a a"), (2, "b"), (None, "a"), (3, None), (4, " ")]
    items = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    lists = inverted_index.postings(items, "doc_id", "text")
    assert "Exchange" not in lists._jdf.queryExecution().executedPlan().toString()
    found = {r.term: list(zip(r.item_id, r.n)) for r in lists.collect()}
    assert found == {"a": [(None, 1), (1, 2), (2, 1)], "b": [(2, 2)], "b\x1cc": [(2, 1)]}
    inverted_index.write(items, f"{tmp_path}/index")
    rows = {r.term: (r.most, [tuple(e) for e in r.entries]) for r in inverted_index.read(spark, f"{tmp_path}/index").collect()}
    assert rows == {t: (max(n for _, n in entries), entries) for t, entries in found.items()}


def test_long_texts_are_embedded_a_few_at_a_time():
    texts = ["a" * 300, None, "b" * 800, "c" * 100, "d" * 5000, ""]
    parts = list(vectors._parts(texts, 1000))
    assert [t for part in parts for t in part] == texts and list(vectors._parts([])) == []
    assert [len(p) for p in parts] == [2, 2, 1, 1]
