import pytest

from lattica.sources.snapshots import Snapshots


def _write(spark, known, rows):
    folder = known.new_folder()
    spark.createDataFrame(rows, "id long, text string").write.parquet(folder)
    return folder


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_versions_of_a_table(spark, tmp_path):
    known = Snapshots(spark, str(tmp_path / "w"))
    assert known.versions() == [] and known.manifest()["tables"] == {}
    assert known.commit(replaced={"t": _write(spark, known, [(1, "a"), (2, "b")])}) == 1
    assert known.commit(appended={"t": _write(spark, known, [(3, "c")])}, batch="x") == 2
    assert known.commit(appended={"t": _write(spark, known, [(9, "z")])}, batch="x") == 2  # the batch is in already
    assert _rows(known.read("t")) == [(1, "a"), (2, "b"), (3, "c")] and _rows(known.read("t", 1)) == [(1, "a"), (2, "b")]
    assert known.commit(changed={"t": (_write(spark, known, [(2, "B"), (4, "d")]), "id")}) == 3
    assert known.commit(changed={"t": (_write(spark, known, [(2, "BB")]), "id")}) == 4
    assert _rows(known.read("t")) == [(1, "a"), (2, "BB"), (3, "c"), (4, "d")]
    assert _rows(known.read("t", 3)) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")] and _rows(known.read("t", 2)) == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(ValueError):
        known.commit(changed={"t": (_write(spark, known, [(2, "q")]), "text")})
    with pytest.raises(ValueError):
        known.read("t", 99)
    with pytest.raises(ValueError):
        known.read("nothing")
    assert known.commit(replaced={"t": _write(spark, known, [(7, "g")]), "u": _write(spark, known, [(8, "h")])}) == 5
    assert _rows(known.read("t")) == [(7, "g")] and _rows(known.read("u")) == [(8, "h")]


def test_a_writer_that_loses_the_race_builds_on_the_winner(spark, tmp_path, monkeypatch):
    known, rival = Snapshots(spark, str(tmp_path / "w")), Snapshots(spark, str(tmp_path / "w"))
    known.commit(replaced={"t": _write(spark, known, [(1, "a")])})
    publish, lost = Snapshots._publish, []

    def late(self, version, manifest):
        if self is known and not lost:
            lost.append(version)
            rival.commit(appended={"t": _write(spark, rival, [(2, "rival")])})
        return publish(self, version, manifest)

    monkeypatch.setattr(Snapshots, "_publish", late)
    assert known.commit(appended={"t": _write(spark, known, [(3, "mine")])}) == 3 and lost == [2]
    assert _rows(known.read("t")) == [(1, "a"), (2, "rival"), (3, "mine")]
    assert not [p for p in (tmp_path / "w" / "_versions").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
