import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.operators import chunking, mentions, relations, sections
from lattica.operators.chunking import ChunkConfig, split_spans
from lattica.operators.mentions import RuleSet


def test_consecutive_chunks_overlap(spark):
    docs = spark.createDataFrame([(1, "This is a test. " * 100), (2, "short"), (3, "")], "document_id long, text string")
    rows = chunking.chunk_documents(docs, ChunkConfig(chunk_size=400, overlap=50, min_chunk_size=10)).orderBy("document_id", "chunk_index").collect()
    first = [r for r in rows if r.document_id == 1]
    assert len(first) > 3
    assert all(b.start_offset < a.end_offset for a, b in zip(first, first[1:]))
    assert [r.content for r in rows if r.document_id == 2] == ["short"]
    assert [r.content for r in rows if r.document_id == 3] == [""]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n!?。한é", min_size=0, max_size=4000))
def test_chunks_cover_the_text_and_keep_characters(text):
    config = ChunkConfig(keep_tail=True)
    data = text.encode()
    spans = split_spans(data, config)
    assert spans[0][0] == 0 and spans[-1][1] == len(data)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d and b - c <= config.overlap + 3
    for a, b in spans:
        data[a:b].decode()
        assert b - a <= config.chunk_size + chunking.BREAK_WINDOW


def test_break_preferences():
    config = ChunkConfig(chunk_size=300, overlap=20, min_chunk_size=10)
    assert split_spans(b"x" * 250 + b"\n\n" + b"y. " * 100, config)[0] == (0, 252)
    assert split_spans(b"x" * 250 + b". " + b"y" * 300, config)[0] == (0, 252)
    assert split_spans(b"x" * 600, config)[0] == (0, 300)
    with pytest.raises(ValueError):
        ChunkConfig(chunk_size=300, overlap=250)


def test_chunks_in_sql(spark):
    chunking.register_sql(spark)
    spark.createDataFrame([("word " * 500,)], "body string").createOrReplaceTempView("bodies")
    rows = spark.sql("SELECT c.* FROM bodies, LATERAL chunk_text(body) c ORDER BY chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows))) and len(rows) > 2


def test_section_chunks_are_numbered_across_sections(spark):
    parts = spark.createDataFrame(
        [(1, 0, None, 1, "a" * 1500), (1, 1, "T", 2, "b" * 10)],
        "document_id long, section_index long, title string, start_page int, content string",
    )
    rows = chunking.chunk_sections(parts).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == [0, 1, 2]
    assert [r.section for r in rows] == [None, None, "T"]


def test_sections(spark):
    text = "preface\n1. Intro\nbody a\n\fbody b\nCHAPTER TWO\nlast"
    rows = sections.sections(spark.createDataFrame([(1, text)], "document_id long, text string")).orderBy("section_index").collect()
    assert [(r.title, r.level, r.start_page, r.content) for r in rows] == [
        (None, 1, 1, "preface"),
        ("1. Intro", 2, 1, "body a\n\x0cbody b"),
        ("CHAPTER TWO", 1, 2, "last"),
    ]


SENTENCES = [
    (1, "연차휴가는 최대 15일까지 사용할 수 있다."),
    (2, "병가 신청시 3일 이상은 진단서를 제출해야 한다."),
    (3, "제12조에 따라 2024-01-15부터 50,000원을 지급한다. tl 확인"),
]


@pytest.fixture(scope="module")
def korean(spark):
    return spark.createDataFrame(SENTENCES, "document_id long, text string")


def test_default_rules(korean):
    found = {(r.document_id, r.text, r.entity_type) for r in mentions.extract(korean).collect()}
    assert {(1, "연차", "AnnualLeave"), (1, "15일", "Days"), (2, "병가", "SickLeave"), (2, "3일", "Days"), (2, "진단서", "Document"),
            (3, "제12조", "Regulation"), (3, "2024-01-15", "Date"), (3, "50,000원", "Amount"), (3, "tl", "Manager")} <= found


def test_offsets_are_bytes(korean):
    texts = {i: t.encode() for i, t in SENTENCES}
    for r in mentions.extract(korean, selected=False, context_bytes=30).collect():
        assert texts[r.document_id][r.start : r.end].decode() == r.text
        assert texts[r.document_id][r.end :].startswith(r.after.encode())


def test_array_selection_equals_scanning(korean, spark):
    everything = mentions.extract(korean, selected=False)
    arrays = everything.groupBy("document_id").agg(F.collect_list(F.struct("start", "end", "text", "entity_type", "confidence")).alias("m"))
    chosen = arrays.select("document_id", F.inline(mentions.select_spans(F.col("m"))))
    key = lambda df: {tuple(r) for r in df.select("document_id", "start", "end", "entity_type").collect()}
    assert key(chosen) == key(mentions.extract(korean))


def test_merge_same_span(spark):
    schema = "document_id long, start long, end long, text string, entity_type string, confidence double"
    rule = spark.createDataFrame([(1, 0, 6, "연차", "AnnualLeave", 0.9), (1, 9, 12, "x", "A", 0.95)], schema)
    model = spark.createDataFrame([(1, 0, 6, "연차", "AnnualLeave", 0.85), (1, 9, 12, "x", "B", 0.9)], schema)
    rows = {r.start: r for r in mentions.merge_extractors(rule, model).collect()}
    assert rows[0].confidence == pytest.approx(0.88)
    assert rows[9].entity_type == "A" and rows[9].confidence == pytest.approx(0.57)


def test_model_answers(one):
    text = F.lit("가나 연차 다 연차")
    parsed = one(mentions.parse_response(F.lit('[{"text":"연차","entity_type":"AnnualLeave"},{"text":"없음","entity_type":"X"}]'), text))
    assert [(m.start, m.end, m.confidence) for m in parsed] == [(7, 13, 0.8)]
    assert one(mentions.parse_response(F.lit("not json"), text)) == []


def test_default_relations(korean):
    found = mentions.extract(korean, context_bytes=relations.context_bytes())
    rows = {(r.document_id, r.subject, r.predicate, r.object) for r in relations.find_relations(found).collect()}
    assert (1, "연차", "requiresDuration", "15일") in rows
    assert (2, "병가", "requiresDocument", "진단서") in rows


def test_relations_equal_all_pairs(spark):
    """The band join against brute force on one text dense in mentions."""
    import random

    rng = random.Random(3)
    text = " ".join(rng.choice(["aaa", "bbb", "key", "zz", "한글"]) for _ in range(600))
    rules = RuleSet((("aaa", "A", 0.9, ""), ("bbb", "B", 0.9, "")), ())
    related = (relations.RelationRule("A", "B", "p", ("key",), 25, 0.8), relations.RelationRule("B", "B", "q", ("zz",), 40, 0.7))
    found = mentions.extract(spark.createDataFrame([(1, text)], "document_id long, text string"), rules, context_bytes=40)
    data, expected = text.encode(), set()
    rows = found.collect()
    for rule in related:
        for s in rows:
            for o in rows:
                if s.entity_type == rule.subject_type and o.entity_type == rule.object_type and s.start != o.start:
                    a, b = sorted((s, o), key=lambda m: m.start)
                    context = data[a.end : b.end + rule.max_distance].decode(errors="ignore")
                    if max(b.start - a.end, 0) <= rule.max_distance and any(k in context for k in rule.keywords):
                        expected.add((s.start, rule.predicate, o.start))
    got = [(r.subject_start, r.predicate, r.object_start) for r in relations.find_relations(found, related).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and expected


def test_relation_answers_and_names(spark, one):
    found = spark.createDataFrame([(1, "a", 5, 6, "T"), (1, "a", 0, 1, "T"), (1, "b", 9, 10, "U")], "document_id long, text string, start long, end long, entity_type string")
    answers = spark.createDataFrame([(1, '[{"subject":"a","predicate":"p","object":"b"},{"subject":"a","predicate":"p","object":"zz"}]')], "document_id long, response string")
    rows = relations.parse_responses(answers, found).collect()
    assert [(r.subject_start, r.object_start, r.confidence) for r in rows] == [(0, 9, 0.8)]
    assert one(relations.relation_type(F.lit("WORKSIN"))) == "worksIn"
    assert one(relations.relation_type(F.lit("nope"))) is None


def test_relations_shuffle_each_mention_once(spark, monkeypatch):
    """One shuffle, no join; stretches and batches may end between the two mentions of a pair, and ids may repeat."""
    import random

    rng = random.Random(5)
    texts = [(i // 2, " ".join(rng.choice(["aaa", "bbb", "key", "zz"]) for _ in range(80))) for i in range(6)] + [(None, "aaa key bbb")]
    rules = RuleSet((("aaa", "A", 0.9, ""), ("bbb", "B", 0.9, "")), ())
    related = (relations.RelationRule("A", "B", "p", ("key",), 25, 0.8), relations.RelationRule("A", "A", "same", ("zz",), 40, 0.7))
    found = mentions.extract(spark.createDataFrame(texts, "document_id long, text string"), rules, context_bytes=40).cache()
    rows, expected = found.collect(), []
    for rule in related:
        for s in rows:
            for o in rows:
                if s.document_id is not None and s.document_id == o.document_id and (s.entity_type, o.entity_type) == (rule.subject_type, rule.object_type) and s.start != o.start:
                    a, b = sorted((s, o), key=lambda m: m.start)
                    gap = b.start - a.end
                    if gap <= rule.max_distance:
                        between = a.after[:gap] + b.text if gap >= 0 else b.text[-gap:]  # ids that repeat mix texts
                        context = between + b.after[: rule.max_distance]
                        expected += [(s.document_id, s.start, rule.predicate, o.start)] if any(k in context for k in rule.keywords) else []
    for stretch, size in ((1 << 16, "10000"), (64, "7")):
        monkeypatch.setattr(relations, "STRETCH", stretch)
        old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = relations.find_relations(found, related)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
            assert sorted((r.document_id, r.subject_start, r.predicate, r.object_start) for r in got.collect()) == sorted(expected) and expected
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_mentions_of_a_batch_come_in_slices(spark):
    """A worker holds the mentions of about SLICE_BYTES of text, whatever the batch."""
    import pyarrow as pa

    from lattica import session

    batch = pa.record_batch([pa.array(range(6)), pa.array(["x" * 40, None, "", "y" * 300, "é" * 30, "z" * 50])], names=["id", "text"])
    parts = list(session.text_slices(batch, 1, 100))
    assert len(parts) > 2 and pa.Table.from_batches(parts) == pa.Table.from_batches([batch])
    assert all(sum(len((t or "").encode()) for t in p.column(1).to_pylist()) < 200 or p.num_rows == 1 for p in parts)

    # Frames of one batch go through the extractor in more than one slice.
    docs = spark.range(40).selectExpr("id AS document_id", "repeat('aaa 1234 ', 12000) AS text").coalesce(1)
    rules = RuleSet((("[0-9]{4}", "N", 0.9, ""),), ())
    assert mentions.extract(docs, rules).count() == 40 * 12000

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        for given, want in (("10000", str(session.TEXT_ROWS)), ("0", str(session.TEXT_ROWS)), ("7", "7")):
            spark.conf.set(key, given)
            session.text_batches(spark)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, old)
