import pytest

from lattica.sources import lookup


def _rows_scanned(df):
    """Rows that the scan of an executed plan put out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_lookups_read_few_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lookup, "ROWS_PER_GROUP", 500)
    folder = str(tmp_path / "t")
    table = spark.range(0, 20_000, 1, 7).selectExpr("id * 3 AS key", "concat('v', id) AS value").repartition(5)
    lookup.write(table, folder, "key")
    found = lookup.find(spark, folder, "key", [30, 30, 59_997, 31, None])
    assert sorted(map(tuple, found.collect())) == [(30, "v10"), (59_997, "v19999")]
    assert _rows_scanned(found) <= 4 * 500
    assert lookup.find(spark, folder, "key", []).collect() == []
    with pytest.raises(ValueError):
        lookup.find(spark, folder, "key", range(lookup.MOST_KEYS + 1))
