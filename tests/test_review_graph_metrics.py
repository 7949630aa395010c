import datetime as dt

import pytest
from pyspark.sql import functions as F

from lattica.operators import accounts, catalog, evaluation, graph, review, telemetry, vectors


def test_queue_status_and_rates(spark):
    rows = spark.createDataFrame([("entity", 0.99), ("entity", 0.5), ("relation", 0.95)], "kind string, confidence double")
    stats = review.queue_stats(review.enqueue(rows)).first()
    assert (stats.auto_approved_entity, stats.pending_entity, stats.auto_approved_relation) == (1, 1, 1)
    assert stats.entity_approval_rate == 1.0 and stats.total_entity == 2
    empty = review.queue_stats(spark.createDataFrame([], "kind string, status string")).first()
    assert empty.entity_approval_rate == 0.0


def test_decisions(spark):
    queue = spark.createDataFrame([(1, "pending", "[1]"), (2, "approved", "[2]"), (3, "pending", "[3]")], "extraction_id long, status string, extracted_entities string")
    at = dt.datetime(2024, 1, 1)
    decisions = spark.createDataFrame(
        [(1, 1, "rejected", "r1", "bad", "why", at, None), (1, 2, "approved", "r2", None, None, at + dt.timedelta(1), None), (2, 3, "rejected", "r3", "x", None, at, None),
         (3, 4, "approved", "r4", None, "ok", at, '{"text":"fixed"}')],
        "extraction_id long, decision_id long, action string, reviewer string, reason string, notes string, reviewed_at timestamp, corrected_entity string",
    )
    first = {r.extraction_id: r for r in review.decide(queue, decisions).collect()}
    assert (first[1].status, first[1].review_notes) == ("rejected", "REJECTED: bad\nwhy")
    assert (first[2].status, first[2].reviewer_id) == ("approved", None)
    assert first[3].extracted_entities == '[{"text":"fixed"}]'
    last = {r.extraction_id: r for r in review.decide_latest(queue, decisions).collect()}
    assert (last[1].status, last[2].status, last[2].review_notes) == ("approved", "rejected", "REJECTED: x\n")


def test_broken_items_are_skipped(spark):
    rows = spark.createDataFrame([(1, '[{"text":"a","entity_type":"T","start":0,"end":1}, 5]', "nonsense"), (2, "[]", '[{"subject":"s","predicate":"p","object":"o"}]')],
                                 "extraction_id long, extracted_entities string, extracted_relations string")
    kinds = [(r.extraction_id, r.extraction_type) for r in review.items(rows, ["extraction_id"]).orderBy("extraction_id").collect()]
    assert (2, "relation") in kinds and all(k in {(1, "entity"), (2, "relation")} for k in kinds)
    assert review.items(rows, ["extraction_id"], "relation").count() == 1


@pytest.fixture(scope="module")
def ring(spark):
    """A cycle of six nodes and a hub joined to each of them."""
    pairs = [(f"n{i}", "next", f"n{(i + 1) % 6}", 0.9) for i in range(6)] + [("hub", "sees", "n0", 0.5)]
    return spark.createDataFrame(pairs, "src string, predicate string, dst string, confidence double")


def test_reachable_gives_smallest_distance(spark, ring):
    seeds = spark.createDataFrame([("n0",)], "node_id string")
    hops = {r.node_id: r.hops for r in graph.reachable(seeds, ring, 4).collect()}
    assert hops == {"n0": 0, "n1": 1, "n5": 1, "hub": 1, "n2": 2, "n4": 2, "n3": 3}


def test_edges_of_ids(spark, ring):
    ids = spark.createDataFrame([("n0",), ("n1",)], "node_id string")
    assert graph.incident_edges(ids, ring).count() == 4
    assert [tuple(r)[:3] for r in graph.induced_subgraph(ids, ring).collect()] == [("n0", "next", "n1")]
    assert {(r.node_id, r.relation_count) for r in graph.degrees(ring).collect()} >= {("n0", 3), ("hub", 1)}


def test_node_texts(one):
    properties = F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), F.lit("2"), F.lit("text"), F.lit("T"), F.lit("start"), F.lit("0"))
    assert one(graph.node_text(F.lit("Class"), F.lit("T"), properties)) == "[Class] - T - a: 2 - z: 1"
    assert one(graph.display_name(F.create_map(F.lit("label"), F.lit("L")))) == "L"
    assert one(graph.display_name(F.create_map(F.lit("x"), F.lit("L")))) == "Unnamed"


def test_graph_search_reaches_depth(spark, ring):
    nodes = spark.createDataFrame([(f"n{i}", "N", f"word{i}", 0.9) for i in range(6)] + [("hub", "H", "center", 0.5)], "node_id string, class string, text string, confidence double")
    nodes = nodes.withColumn("properties", F.create_map(F.lit("text"), "text"))
    asked = spark.createDataFrame([(1, "where is word3")], "request_id long, question string")
    found = graph.search(nodes, ring, asked, limit=20, depth=2, seed_limit=5, relation_limit=10).orderBy("position").collect()
    assert [r.hit_id for r in found if r.kind == "node"] == ["n3", "n2", "n4", "n1", "n5"]
    assert {r.content for r in found if r.kind == "relation"} >= {"word2 [next] word3", "word5 [next] word0"}
    assert [r.hit_id for r in graph.search(nodes, ring, asked, limit=2, depth=2).orderBy("position").collect()] == ["n3", "n2"]


def test_loading(spark):
    found = spark.createDataFrame([(1, 0, 2, "a", "T", 0.9), (1, 5, 7, "a", "U", 0.99), (1, 8, 9, "b", "T", 0.8)],
                                  "document_id long, start long, end long, text string, entity_type string, confidence double")
    related = spark.createDataFrame([(1, "a", "p", "b", 0.9), (1, "a", "p", "missing", 0.9)], "document_id long, subject string, predicate string, object string, confidence double")
    nodes = graph.load_nodes(found)
    edges = graph.load_edges(related, nodes)
    assert {(r.text, r["class"]) for r in nodes.collect()} == {("a", "T"), ("b", "T")}
    assert edges.count() == 1
    assert graph.load_summary(nodes, edges).first().asDict() == {"document_id": 1, "entities_loaded": 2, "relations_loaded": 1}


@pytest.mark.parametrize("tp, fp, fn, f1", [(80, 20, 20, 0.8), (2, 0, 0, 1.0), (0, 0, 0, 0.0), (1, 1, 1, 0.5)])
def test_scores(spark, tp, fp, fn, f1):
    row = evaluation.scores(spark.createDataFrame([(tp, fp, fn)], "tp long, fp long, fn long")).first()
    assert row.f1 == f1
    assert row.precision == (round(tp / (tp + fp), 6) if tp + fp else 0.0)


def test_entity_matching_is_one_to_one(spark):
    schema = "document_id long, start long, end long, text string, entity_type string"
    predicted = spark.createDataFrame([(1, 0, 1, "a", "T"), (1, 2, 3, "a", "T"), (1, 4, 5, "b", "T")], schema)
    gold = spark.createDataFrame([(1, 0, 1, "a", "T"), (1, 4, 5, "b", "U")], schema)
    counts = evaluation.entity_counts(predicted, gold, []).first()
    assert (counts.tp, counts.fp, counts.fn) == (1, 2, 1)
    loose = evaluation.entity_counts(predicted, gold, [], match_types=False).first()
    assert (loose.tp, loose.fp, loose.fn) == (2, 1, 0)
    summary = evaluation.scores(evaluation.total_counts(evaluation.entity_counts(predicted, gold, ["document_id"])))
    row = evaluation.targets_met(summary, summary).first()
    assert row.entity_precision == row.relation_precision == pytest.approx(1 / 3) and row.ner_ok is False


def test_percentiles_match_sorted_values(spark):
    import random

    rng = random.Random(1)
    values = [("e", rng.expovariate(0.01)) for _ in range(2000)] + [("e", 5.0)] * 900 + [("f", 1.0)]
    row = {r.k: r for r in telemetry.exact_percentiles(spark.createDataFrame(values, "k string, v double"), "k", "v").collect()}
    data = sorted(v for k, v in values if k == "e")
    for name, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
        position = (len(data) - 1) * q
        low = data[int(position)]
        high = data[min(int(position) + 1, len(data) - 1)]
        assert row["e"][name] == pytest.approx(low + (high - low) * (position - int(position)), abs=1e-5)
    assert row["f"].p99 == 1.0


def test_histogram_and_midpoints(spark):
    requests = spark.createDataFrame([("e", float(v)) for v in (5, 9, 20, 70, 700, 5000)], "endpoint string, latency_ms double")
    hist = telemetry.histogram(requests)
    assert [r.cumulative for r in hist.orderBy("bucket").collect()] == [2, 3, 4, 4, 5, 6]
    assert tuple(telemetry.histogram_percentiles(hist).first())[1:] == (0.03, 0.75, 0.75)


def test_cache_statistics(spark):
    row = telemetry.cache_stats(spark.createDataFrame([(True,), (False,), (False,)], "hit boolean"), []).first()
    assert row.hit_rate == pytest.approx(1 / 3) and row.total_requests == 3


def test_streaks_across_days(spark):
    start = dt.datetime(2024, 1, 1, 23)
    rows = [(i, "u", start + dt.timedelta(minutes=30 * i), kind) for i, kind in enumerate("fffsffff" + "f" * 60 + "sff")]
    df = spark.createDataFrame(rows, "id long, user string, at timestamp_ntz, kind string")
    streaks = accounts.failure_streaks(df, "user", "at", "id", F.col("kind") == "f", F.col("kind") == "s")
    expected, n = {}, 0
    for i, _, _, kind in rows:
        n = 0 if kind == "s" else n + 1
        expected[i] = n
    assert {r.id: r.failed_attempts for r in streaks.collect()} == expected


def test_attempts_inside_a_lock_are_refused(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "u", start + dt.timedelta(minutes=i), False) for i in range(8)] + [(8, "u", start + dt.timedelta(minutes=40), True), (9, "v", start, False)]
    df = spark.createDataFrame(rows, "id long, user string, at timestamp_ntz, ok boolean")
    got = {r.id: (r.outcome, r.failed_attempts) for r in accounts.judged(df, "user", "at", "id", F.col("ok")).collect()}
    assert [got[i][0] for i in range(9)] == ["failure"] * 4 + ["locked"] + ["refused"] * 3 + ["success"]
    assert got[7] == ("refused", 5) and got[8][1] == 0 and got[9] == ("failure", 1)


def test_vector_table_changes(spark):
    table = spark.createDataFrame([(1, 10, [1.0]), (2, 10, [2.0]), (3, 11, [3.0])], "id long, document_id long, vector array<float>")
    changed = vectors.upsert(table, spark.createDataFrame([(2, 10, [9.0]), (4, 12, [4.0])], "id long, document_id long, vector array<float>"))
    assert {r.id: r.vector[0] for r in changed.collect()} == {1: 1.0, 2: 9.0, 3: 3.0, 4: 4.0}
    rest, removed = vectors.delete_by_document(table, spark.createDataFrame([(10,)], "document_id long"))
    assert rest.count() == 1 and removed.first().removed == 2
    good, bad = vectors.check_dimension(table, 2)
    assert good.count() == 0 and bad.count() == 3


def test_soft_delete(spark):
    docs = spark.createDataFrame([(1, None), (2, None)], "document_id long, deleted_at timestamp")
    after = catalog.soft_delete(docs, spark.createDataFrame([(2,)], "document_id long"), F.lit("2024-01-01").cast("timestamp"))
    assert [r.document_id for r in catalog.live(after).collect()] == [1]
    chunks = spark.createDataFrame([(1, "a"), (2, "b")], "document_id long, content string")
    assert [r.content for r in catalog.live_chunks(chunks, after).collect()] == ["a"]


def _replayed(rows):
    """Outcomes of (user, us, id, ok) judged one after another."""
    out, states = {}, {}
    for user, us, i, ok in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        outcome, failed, until = accounts.attempt(*states.get(user, (0, None)), us, ok)
        states[user] = failed, until
        out[i] = (outcome, failed, until)
    return out


def test_a_hot_account_is_judged_in_stretches(spark):
    import random

    rng = random.Random(3)
    rows, at = [], {}
    for i in range(3000):
        user = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None, *(f"u{k}" for k in range(40))])
        at[user] = at.get(user, 0) + rng.choice([0, 1, 30, 200, 400, 2000]) * 1_000_000
        rows.append((user, at[user], i, rng.random() < (0.04 if user == "hot" else 0.3)))
    df = spark.createDataFrame(rows, "user string, us long, id long, ok boolean").repartition(5)
    df = df.withColumn("at", F.timestamp_micros("us"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = accounts.judged(df, "user", "at", "id", F.col("ok"))
        found = {r.id: (r.outcome, r.failed_attempts, r.u) for r in got.withColumn("u", F.unix_micros("locked_until")).collect()}
        parts = df.where("user = 'hot'").join(df.repartitionByRange("user", "us", "id").select("id", F.spark_partition_id().alias("p")), "id").groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found == _replayed(rows)
    assert len(parts) > 3 and max(r["count"] for r in parts) < 500


def test_passages_lead_where_replaying_leads():
    import random

    rng = random.Random(5)
    for _ in range(300):
        instants = sorted(rng.randrange(0, 40 * 60) * 1_000_000 for _ in range(rng.randrange(1, 40)))
        successes = [rng.random() < rng.choice([0.0, 0.1, 0.5]) for _ in instants]
        crossed = accounts.passage(instants, successes)
        for failed in range(9):
            for until in (None, *(instants[0] + rng.randrange(-5, 15 * 60) * 1_000_000 for _ in range(4))):
                state = failed, until
                for us, ok in zip(instants, successes):
                    _, *state = accounts.attempt(*state, us, ok)
                count, lock = crossed.leave(failed, until)
                # A lock that ended within the stretch is as good as none.
                ended = lambda x: None if x is None or x <= instants[-1] else x
                assert (count, ended(lock)) == (state[0], ended(state[1])), (instants, successes, failed, until)
