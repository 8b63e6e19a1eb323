"""Documents landed as files, one each."""

from tidewatch.catalog import Tables, quality
from tidewatch.sources import sinks


def test_a_feed_lands_as_plain_files(spark, tmp_path, monkeypatch):
    spark.range(1000).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(quality, "fresh_path", lambda spark, label: f"{tmp_path}/{label}")
    rows, rejects = quality.landed_feed(Tables(spark, str(tmp_path)), "gdacs")
    files = [p for p in (tmp_path / "landed-gdacs").rglob("*") if p.is_file()]
    assert len(files) == 36 and {p.parent.name for p in files} == {"code=EQ", "code=FL", "code=TC"}
    assert all(p.suffix == ".txt" and p.read_text().endswith("\n") for p in files)
    assert rejects.count() == 3 and rows.filter("source_id like 'FL%'").count() > 0


def test_documents_as_files_of_any_store(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.docs.link./in", f"file://{tmp_path}/far")
    (tmp_path / "far").mkdir()
    rows = spark.createDataFrame([(1, "a", "é"), (2, "a", "two\nlines"), (None, "b/c", None), (4, "", "four")], "page int, kind string, body string")
    for path in (f"{tmp_path}/near", f"file:{tmp_path}/near2", "viewfs://docs/in/far"):
        sinks.write_documents(rows, path, "page", ["kind"])
        sinks.write_documents(rows.filter("page = 1"), path, "page", ["kind"]) if "near" in path else None
        got = spark.read.text(path, wholetext=True).collect()
        assert sorted((r["kind"] or "", r["value"]) for r in got) == [("", "four\n"), ("a", "two\nlines\n"), ("a", "é\n"), ("b/c", "\n")]
