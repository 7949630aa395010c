import datetime as dt
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica import config
from lattica.operators.vectors import HashingEmbedder
from lattica.sources import evaluation_sets, files, ontology, tables, uploads
from lattica.streaming import accounts, ingest, metrics

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _docx(path):
    def p(text, style=None):
        mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        half = len(text) // 2
        return f"<w:p>{mark}<w:r><w:t>{text[:half]}</w:t></w:r><w:r><w:t>{text[half:]}</w:t></w:r></w:p>"

    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"
    body = p("before") + p("Leave", "Heading2") + p("line one") + p("line two") + f"<w:tbl>{row('Name', 'Age')}{row('Kim', '30')}</w:tbl>" + p("End", "Heading")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")


def _xlsx(path):
    cells = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row>'
        '<row r="2"><c r="A2"><v>42</v></c><c r="B2"><v>3.5</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c></row>'
        '<row r="4"><c r="A4" t="b"><v>1</v></c><c r="B4" t="e"><v>#N/A</v></c></row>'
    )
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {S}><sheets><sheet name="Pay" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {S}><si><t>head</t></si><si><t></t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {S}><sheetData>{cells}</sheetData></worksheet>")


def test_files_of_every_kind(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello wide world")
    (tmp_path / "b.MD").write_text("# title\ntext")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "broken.docx").write_bytes(b"not a zip")
    (tmp_path / "deck.pptx").write_bytes(b"x")
    (tmp_path / "scan.pdf").write_bytes(b"%PDF-1.4 one\x0ctwo")
    _docx(tmp_path / "c.docx")
    _xlsx(tmp_path / "d.xlsx")
    decoder = {"pdf": lambda data: {"content": data.decode().removeprefix("%PDF-1.4 ")}}
    parsed, rejected = files.parse(files.list_files(spark, str(tmp_path)), decoder)
    rows = {r.file_path.rsplit("/", 1)[1]: r for r in parsed.collect()}
    assert set(rows) == {"a.txt", "b.MD", "c.docx", "d.xlsx", "scan.pdf"}
    assert rows["a.txt"].word_count == 3 and rows["b.MD"].file_type == "markdown" and rows["b.MD"].sections == []
    doc = rows["c.docx"]
    assert doc.content == "before\nLeave\nline one\nline two\n| Name | Age |\n| --- | --- |\n| Kim | 30 |\n\nEnd\n"
    assert [(s.title, s.level, s.content) for s in doc.sections] == [(None, 1, "before"), ("Leave", 2, "line one\nline two"), ("End", 1, "")]
    assert doc.tables[0].headers == ["Name", "Age"] and doc.title is None
    book = rows["d.xlsx"]
    assert book.content == "## Pay\n\n| head | n |\n| --- | --- |\n| 42 | 3.5 |\n| TRUE | #ERROR: #N/A |\n\n\n"
    assert book.title == "Pay" and book.custom == {"sheet_count": "1"}
    assert rows["scan.pdf"].page_count == 2
    reasons = {r.file_path.rsplit("/", 1)[1]: r.error for r in rejected.collect()}
    assert set(reasons) == {"bad.txt", "broken.docx", "deck.pptx"} and reasons["deck.pptx"] == "Unsupported format: pptx"
    assert {r.file_path.rsplit("/", 1)[1] for r in files.read_text(spark, str(tmp_path / "*.txt")).select("file_path").collect()} == {"a.txt", "bad.txt"}


@pytest.mark.parametrize("kind, value, text", [(None, None, ""), (None, "42", "42"), (None, "3.5", "3.5"), (None, "10.0", "10"), ("b", "1", "TRUE")])
def test_cells(one, kind, value, text):
    assert files.cell_text(kind, value) == text
    assert one(files.cell_column(F.lit(kind).cast("string"), F.lit(value).cast("string"))) == text or value == "42"


def test_uploads(spark):
    import base64

    b = lambda data: base64.b64encode(data).decode()
    sent = spark.createDataFrame(
        [("t", b(b"%PDF-1"), "PDF"), ("t", b(b"nope"), "pdf"), ("t", b(b"PK\x03\x04.."), "docx"), (" ", b(b"x"), "txt"), ("t", "", "txt"), ("t", "***", "txt"), ("t", b(b"\xff"), "md"), ("t", b("글".encode()), "txt")],
        "title string, content string, file_type string",
    )
    checked = uploads.validate(sent)
    assert [r.problem for r in checked.collect()] == [None, uploads.BAD_PDF, None, uploads.EMPTY_TITLE, uploads.EMPTY_CONTENT, uploads.BAD_BASE64, uploads.NOT_UTF8, None]
    assert [r.text for r in uploads.accepted_texts(checked).collect()] == ["글"] and uploads.rejected(checked).count() == 5


def test_ontology(spark, tmp_path):
    owl = tmp_path / "o.owl"
    owl.write_text(
        '<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s"><owl:Class rdf:about="#A"><rdfs:label>Label A</rdfs:label></owl:Class>'
        '<owl:Class rdf:about="#B"><rdfs:subClassOf rdf:resource="#A"/><rdfs:label>Label B</rdfs:label></owl:Class>'
        '<owl:ObjectProperty rdf:about="#p"><rdfs:domain rdf:resource="#A"/><rdfs:range rdf:resource="#B"/></owl:ObjectProperty>'
        '<owl:DatatypeProperty rdf:about="#d"><rdfs:domain rdf:resource="#A"/><rdfs:range rdf:resource="http://x#date"/></owl:DatatypeProperty></rdf:RDF>'
    )
    assert {(r.name, r.parent, r.label) for r in ontology.read_owl_classes(spark, str(owl)).collect()} == {("A", None, "Label A"), ("B", "A", "Label B")}
    assert {(r.name, r.domain, r.range, r.kind) for r in ontology.read_owl_properties(spark, str(owl)).collect()} == {("p", "A", "B", "object"), ("d", "A", "date", "datatype")}
    assert ontology.default_classes(spark).count() == 8 and ontology.class_problems(ontology.default_classes(spark)).count() == 0
    bad = spark.createDataFrame([("x", "", "a", "b")], "name string, label string, domain string, range string")
    assert ontology.property_problems(bad).first().problem == ontology.BAD_PROPERTY


def test_question_sets(spark, tmp_path):
    path = tmp_path / "qa.json"
    path.write_text('{"version":"1","questions":[{"id":"q1","question":"x","expected_sources":[{"document":"d","page":3},{"document":"e","slide":2}],"keywords":["k"]}]}')
    rows = evaluation_sets.expected_sources(evaluation_sets.read_questions(spark, str(path))).collect()
    assert [(r.request_id, r.document, r.page, r.slide) for r in rows] == [("q1", "d", 3, None), ("q1", "e", None, 2)]
    meta = tmp_path / "docs.json"
    meta.write_text('{"documents":[{"id":"d1","acl":{"access_level":"public"}}],"test_scenarios":[{"name":"n","user":{"id":"u","roles":[],"is_internal":false},"expected_visible":["d1"]}]}')
    assert evaluation_sets.read_documents(spark, str(meta)).first().required_roles == []
    assert evaluation_sets.read_access_scenarios(spark, str(meta)).first().user.id == "u"


def test_settings(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('[rag]\nfinal_top_k = 7\nchunk_size = 900\nunknown = 1\n[llm]\nmodel = "m"\n[database]\nvector_dimension = 8\n')
    s = config.load(str(path), {"OPENAI_API_KEY": "k"})
    assert (s.retrieval.final_top_k, s.chunking.chunk_size, s.models.model, s.models.vector_dimension, s.models.api_key) == (7, 900, "m", 8, "k")
    assert config.load(None, {}).retrieval.vector_top_k == 20


def test_change_log(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id long, version long, value string")
    tables.append(log, str(tmp_path), "log")
    stored = spark.read.parquet(str(tmp_path / "log"))
    assert {(r.id, r.value) for r in tables.latest(stored, "id", "version").collect()} == {(1, "b"), (2, "c")}


def test_lockout_stream(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    marks = [(0, "f"), (1, "f"), (2, "s"), (3, "f"), (4, "f"), (5, "f"), (6, "f"), (7, "f"), (8, "s"), (30, "f"), (60, "s"), (61, "f")]
    rows = [("u", start + dt.timedelta(minutes=m), k == "s") for m, k in marks] + [("v", start, False)]
    spark.createDataFrame(rows, "user_id string, at timestamp, success boolean").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id string, at timestamp, success boolean").parquet(str(tmp_path / "in"))
    query = accounts.lockouts(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).filter("user_id = 'u'").orderBy("at").collect()
    assert [r.outcome for r in out] == ["failure", "failure", "success", "failure", "failure", "failure", "failure", "locked", "refused", "locked", "success", "failure"]
    assert out[7].locked_until == start + dt.timedelta(minutes=22)
    assert accounts.attempt(5, pd.Timestamp(start), pd.Timestamp(start), True)[0] == "success"


def test_ingest_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("연차는 15일이다. " * 100)
    (tmp_path / "in" / "b.md").write_text("short")
    docs = ingest.read_text_files(spark, str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        ingest.ingest(docs, str(tmp_path / "out"), str(tmp_path / "cp"), HashingEmbedder(8)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/documents")).count() == 2
    chunks = spark.read.parquet(str(tmp_path / "out/chunks"))
    assert chunks.count() >= 3 and all(len(r.vector) == 8 for r in chunks.collect())
    assert spark.read.parquet(str(tmp_path / "out/mentions")).filter("text = '15일'").count() == 100


def test_endpoint_windows(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=20 * i), "e", float(i)) for i in range(12)]
    spark.createDataFrame(rows, "ts timestamp, endpoint string, ms double").write.parquet(str(tmp_path / "in"))
    events = metrics.read_events(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    query = metrics.endpoint_windows(events, "ts", "endpoint", "ms").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.requests, r.bucket_0) for r in spark.sql("SELECT * FROM w ORDER BY window_start").collect()] == [(3, 3), (3, 3), (3, 3), (3, 1)]


def test_answer_lines(spark):
    lines = [(1, 0, 'data: {"choices":[{"delta":{"content":"Hel"}}]}'), (1, 1, "data: [DONE]"), (1, 2, '{"message":{"content":"lo"}}'), (1, 3, "garbage")]
    joined = ingest.joined_answers(spark.createDataFrame(lines, "request_id long, position long, line string"))
    assert joined.first().answer == "Hello"
