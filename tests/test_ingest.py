import pytest
from pyspark.sql import functions as F
from test_sources_streaming import _docx, _xlsx

from lattica import schemas
from lattica.operators import catalog, graph, review
from lattica.plans.ingest import WRITTEN, ingest_folder
from lattica.sources import document_format
from lattica.sources.snapshots import Snapshots
from lattica.sources.tables import read_table

KOREAN = "연차휴가는 최대 15일까지 사용할 수 있다. 병가 신청시 진단서를 제출해야 한다."
PDF = "1. 휴가\n" + KOREAN + "\n\f2. 기타\nother words"


@pytest.fixture()
def folder(tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "leave.txt").write_text(KOREAN)
    (path / "long.md").write_text("Plain words follow here. " * 200)
    (path / "x.pptx").write_bytes(b"?")
    (path / "scan.pdf").write_bytes(PDF.encode())
    (path / "broken.docx").write_bytes(b"no zip")
    _docx(path / "c.docx")
    _xlsx(path / "d.xlsx")
    return path


def test_folder_to_graph(spark, folder, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def pdf(data):
        import uuid

        (calls / uuid.uuid4().hex).write_text("")
        return {"content": data.decode()}

    root = str(tmp_path / "tables")
    counts = {r.table: r.rows for r in ingest_folder(spark, str(folder), root, department="HR", decoders={"pdf": pdf}, approve_from=0.5).collect()}
    assert set(counts) == {*WRITTEN, "rejected"}
    assert counts["documents"] == 5 and counts["rejected"] == 2 and counts["chunks"] > 5 and counts["relations"] == 6
    assert len(list(calls.iterdir())) == 1  # each file is decoded once

    written = {name: read_table(spark, root, name) for name in ("documents", "chunks", "vectors", "nodes", "edges")}
    for name, optional in (("documents", {"owner_id", "deleted_at"}), ("chunks", {"page", "section"}), ("vectors", {"owner_id"}), ("nodes", set()), ("edges", set())):
        df = Snapshots(spark, root).read(name)
        assert set(df.columns) == {f.split(" ")[0] for f in schemas.TABLES[name].replace("source struct<document_id:string,page:int,section:string,offset:bigint,confidence:double>", "source x").split(", ")}
        empty = written[name].select([F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in written[name].columns if c not in optional]).first()
        assert not any(empty), (name, empty)
    assert {r.department for r in written["vectors"].select("department").distinct().collect()} == {"HR"}
    assert catalog.live(written["documents"]).count() == 5

    names = {r.document_id: r.title for r in written["documents"].collect()}
    sections = {(names[r.document_id], r.section, r.page) for r in written["chunks"].collect()}
    assert {("leave.txt", None, None), ("1. 휴가", "1. 휴가", 1)} <= sections or ("scan.pdf", "1. 휴가", 1) in sections
    chunks = written["chunks"].groupBy("document_id").agg(F.countDistinct("chunk_index").alias("n"), F.max("chunk_index").alias("last")).collect()
    assert all(r.n == r.last + 1 for r in chunks)

    texts = sorted(r.content for r in graph.edge_texts(written["edges"], written["nodes"]).collect())
    # Either order counts: "15일까지 ... 병가" also puts the keyword 까지 behind the earlier mention.
    assert texts == sorted(["연차 [requiresDuration] 15일", "병가 [requiresDuration] 15일", "병가 [requiresDocument] 진단서"] * 2)
    places = {(r.source.section, r.source.page) for r in written["edges"].collect()}
    assert places == {(None, None), ("1. 휴가", 1)}


def test_doubtful_extractions_wait_for_review(spark, folder, tmp_path):
    root = str(tmp_path / "tables")
    ingest_folder(spark, str(folder), root).collect()
    related, nodes = Snapshots(spark, root).read("relations"), read_table(spark, root, "nodes")
    assert {r.status for r in related.collect()} == {"pending"} and read_table(spark, root, "edges").count() == 0
    assert nodes.count() == review.approved(Snapshots(spark, root).read("mentions")).select("document_id", "text").distinct().count() > 0


def test_a_run_that_dies_leaves_the_old_version(spark, folder, tmp_path):
    root = str(tmp_path / "tables")
    first = sorted(map(tuple, ingest_folder(spark, str(folder), root, batch="monday").collect()))
    (folder / "late.txt").write_text("one more")

    class Broken:
        dimension = 4

        def embed_batch(self, texts):
            raise RuntimeError("no service")

    with pytest.raises(Exception, match="no service"):
        ingest_folder(spark, str(folder), root, embedder=Broken(), batch="tuesday").collect()
    assert Snapshots(spark, root).versions() == [1] and read_table(spark, root, "documents").count() == dict(first)["documents"]
    # A batch that is already in is not written again, whatever the folder holds by now.
    assert sorted(map(tuple, ingest_folder(spark, str(folder), root, batch="monday").collect())) == first
    ingest_folder(spark, str(folder), root, batch="tuesday").collect()
    known = Snapshots(spark, root)
    assert known.versions() == [1, 2] and known.read("documents").count() == dict(first)["documents"] + 1
    assert known.read("documents", version=1).count() == dict(first)["documents"]


def _names(df):
    return {r.file_path.rsplit("/", 1)[1]: r for r in df.collect()}


def test_documents_as_a_format(spark, folder):
    document_format.register(spark, {"pdf": lambda data: {"content": data.decode()}})
    rows = _names(spark.read.format("documents").load(str(folder)))
    assert set(rows) == {"leave.txt", "long.md", "x.pptx", "scan.pdf", "broken.docx", "c.docx", "d.xlsx"}
    assert {n for n, r in rows.items() if r.error} == {"x.pptx", "broken.docx"} and rows["x.pptx"].error == "Unsupported format: pptx"
    assert rows["scan.pdf"].page_count == 2 and rows["scan.pdf"].title == "1. 휴가" and rows["leave.txt"].content == KOREAN
    assert [s.title for s in rows["c.docx"].sections] == [None, "Leave", "End"] and rows["d.xlsx"].custom == {"sheet_count": "1"}
    assert set(_names(spark.read.format("documents").option("pathGlobFilter", "*.txt").load(str(folder)))) == {"leave.txt"}
    many = spark.read.format("documents").option("bytesPerTask", "2000").load(str(folder))
    assert many.rdd.getNumPartitions() > 2 and set(_names(many)) == set(rows)


def test_documents_as_a_format_give_what_the_listing_gives(spark, folder):
    from lattica.sources import files

    document_format.register(spark)
    listed = {n: r.asDict(True) for n, r in _names(files.parsed_rows(files.list_files(spark, str(folder)))).items()}
    read = {n: r.asDict(True) for n, r in _names(spark.read.format("documents").load(str(folder))).items()}
    for rows in (listed, read):
        for row in rows.values():
            row.pop("file_path")
    assert listed == read


def test_documents_as_a_stream(spark, folder, tmp_path):
    import os

    document_format.register(spark)
    stream = spark.readStream.format("documents").load(str(folder))

    def run():
        query = stream.select("file_path", "word_count", "error").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination(120)
        assert query.exception() is None
        return sorted(r.file_path.rsplit("/", 1)[1] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = run()
    assert first == sorted(p.name for p in folder.iterdir())
    (folder / "new.txt").write_text("one more file")
    later = max(p.stat().st_mtime for p in folder.iterdir()) + 5
    os.utime(folder / "new.txt", (later, later))
    assert run() == sorted([*first, "new.txt"])  # what was read before is not read again
    assert run() == sorted([*first, "new.txt"])
