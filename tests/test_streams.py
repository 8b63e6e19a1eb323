"""Feeds as streams: rejects, provenance, restarts, folded change logs, and what happens when only time passes."""

import json
import time

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidewatch.streaming import feeds, timers


def quake(name, size=5.0):
    return {"id": name, "geometry": {"coordinates": [10.0, 20.0, 5.0]},
            "properties": {"mag": size, "place": "sea", "time": 1704067200000, "title": f"M {size}"}}


def land(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_broken_documents_are_rejected_with_their_file(spark, tmp_path):
    inbox, home = tmp_path / "in", str(tmp_path / "home")
    body = json.dumps({"features": [quake("a"), quake("b", 6.1)]}, indent=1)
    land(inbox, "one.json", body)
    land(inbox, "cut.json", body[:60])
    land(inbox, "other.json", '{"events": []}')
    land(inbox, "blank.json", " \n")
    land(inbox / "deeper", "none.json", '{"features": []}')

    def run():
        stream = feeds.landed_documents(spark, str(inbox), files_per_batch=2)
        rows, rejects = feeds.feed_readings(stream, "usgs", "quakes", F.current_timestamp(), home)
        return rows.collect(), rejects.collect()

    rows, rejects = run()
    assert sorted((r["source_id"], r["file"].rsplit("/", 1)[-1]) for r in rows) == [("a", "one.json"), ("b", "one.json")]
    assert sorted((r["file"].rsplit("/", 1)[-1], r["reason"]) for r in rejects) == [
        ("blank.json", "empty"), ("cut.json", "not a usgs document"), ("other.json", "not a usgs document")]
    assert next(r["body"] for r in rejects if r["reason"] == "not a usgs document" and "cut" in r["file"]) == body[:60]
    land(inbox, "two.json", json.dumps({"features": [quake("c")]}))
    again, same = run()
    assert sorted(r["source_id"] for r in again) == ["a", "b", "c"] and len(same) == 3


def test_nothing_landed_yet(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows, rejects = feeds.feed_readings(feeds.landed_documents(spark, str(tmp_path / "in")), "eonet", "events", F.current_timestamp())
    assert rows.count() == 0 and rejects.count() == 0 and "file" in rows.columns


def test_many_small_documents_are_one_batch(spark, tmp_path):
    for k in range(150):
        land(tmp_path / "in", f"{k}.json", json.dumps({"features": [quake(f"q{k}")]}))
    home = tmp_path / "home"
    rows, _ = feeds.feed_readings(feeds.landed_documents(spark, str(tmp_path / "in")), "usgs", "quakes", F.current_timestamp(), str(home))
    assert rows.count() == 150 and len(list((home / "out").glob("batch=*"))) == 1


class Runs(StreamingQueryListener):
    """The runs of streams that have ended, and the rows that their batches read."""

    def __init__(self):
        self.rows, self.ended = 0, []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended.append(str(event.runId))


def test_a_task_reads_many_documents_and_each_once(spark, tmp_path):
    for k in range(150):
        land(tmp_path / "in", f"{k}.json", json.dumps({"features": [quake(f"q{k}")]}) if k % 3 else "cut")
    runs, opening = Runs(), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.streams.addListener(runs)
    try:
        rows, rejects = feeds.feed_readings(feeds.landed_documents(spark, str(tmp_path / "in")), "usgs", "quakes", F.current_timestamp())
        for _ in range(100):
            if runs.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(runs)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(runs.ended[0]) for s in tracker.getJobInfo(j).stageIds]
    assert rows.count() == 100 and rejects.count() == 50
    assert runs.rows == 150 and sum(s.numTasks for s in stages if s) <= 2 * feeds.LISTING
    assert spark.conf.get("spark.sql.files.openCostInBytes") == opening
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_folder_names_the_hazard_code(spark, tmp_path):
    alert = {"geometry": {"coordinates": [1.0, 2.0]}, "properties": {
        "eventid": "7", "name": "Flood", "fromdate": "2024-01-01T00:00:00", "iscurrent": "true", "alertlevel": "Red"}}
    land(tmp_path / "in" / "code=FL", "a.json", json.dumps({"features": [alert]}))
    rows, _ = feeds.feed_readings(feeds.landed_documents(spark, str(tmp_path / "in")), "gdacs", "alerts", F.current_timestamp())
    assert [(r["source_id"], r["type"], r["alert"]) for r in rows.collect()] == [("FL7", "flood", "red")]


def test_change_logs_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "FOLDED", 2)
    home, inbox = str(tmp_path / "home"), tmp_path / "in"
    for day in range(5):
        rows = [(f"k{day % 3}", day, f"v{day}"), ("always", day, str(day))]
        spark.createDataFrame(rows, "key string, at long, value string").coalesce(1).write.mode("append").parquet(str(inbox))
        stream = feeds.landed(spark, str(inbox), "key string, at long, value string")
        got = {r["key"]: r["value"] for r in feeds.keep_latest(stream, "latest", ["key"], ["at"], home=home).collect()}
        assert got["always"] == str(day) and got[f"k{day % 3}"] == f"v{day}" and len(got) == min(day + 1, 3) + 1
    assert len(feeds._logs(spark, home)) <= 3 and any(n.startswith("folded=") for n in feeds._logs(spark, home))


def changes(spark, home, schema):
    return spark.read.schema(schema).parquet(f"{home}/out").collect()


def test_a_silent_source_turns_stale_and_then_unavailable(spark, tmp_path):
    inbox = str(tmp_path / "in")
    now = int(time.time())
    schema = "source string, at long, ok boolean, events long, error string"
    spark.createDataFrame([("usgs", now, True, 12, None), ("gdacs", now - 1, True, 3, None), ("gdacs", now, False, None, "Timeout"),
                           ("eonet", now, False, None, "Refused")], schema).write.parquet(inbox)
    stream = timers.source_clock(spark.readStream.schema(schema).parquet(inbox), stale_seconds=8, expire_seconds=20)
    query, home = timers.start(stream, str(tmp_path / "home"), every="1 second")
    try:
        for _ in range(90):
            time.sleep(1)
            told = [r for r in changes(spark, home, timers.STATUS) if r["source"] == "usgs"] if (tmp_path / "home/out").exists() else []
            if any(r["status"] == "unavailable" for r in told):
                break
    finally:
        query.stop()
    rows = changes(spark, home, timers.STATUS)
    assert [r["status"] for r in sorted(told, key=lambda r: r["changed_at"])] in (["ok", "stale", "unavailable"], ["stale", "unavailable"])
    assert {r["count"] for r in told if r["status"] != "unavailable"} == {12} and told[-1]["at"] in (now, None)
    assert {r["status"] for r in rows if r["source"] == "eonet"} == {"unavailable"}
    assert next(r for r in rows if r["source"] == "gdacs" and r["status"] == "stale")["error"] == "Timeout"


def test_seen_marks_outlive_a_restart(spark, tmp_path):
    inbox, home = str(tmp_path / "in"), str(tmp_path / "home")
    schema = "person string, kind string, number long"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        before = len(changes(spark, home, timers.MARKS)) if (tmp_path / "home/out").exists() else 0
        query, _ = timers.start(timers.seen_marks(spark.readStream.schema(schema).parquet(inbox)), home)
        query.awaitTermination()
        batch = max(int(p.name.split("=")[1]) for p in (tmp_path / "home/out").iterdir())
        rows = spark.read.schema(timers.MARKS).parquet(f"{home}/out/batch={batch}").collect()
        return before, {(r["person"], r["number"], r["unseen"], r["notice"]) for r in rows}

    assert run([("ana", "task", 3), ("ana", "task", 1), ("bo", "task", 2)])[1] == {("ana", 3, True, False), ("bo", 2, True, False)}
    assert run([("ana", "seen", None)])[1] == {("ana", 3, False, False)}
    assert run([("ana", "task", 5), ("ana", "task", 2)])[1] == {("ana", 5, True, True), ("ana", 5, True, False)}
    assert run([("ana", "seen", 5), ("bo", "seen", 1)])[1] == {("ana", 5, False, False), ("bo", 2, True, False)}
