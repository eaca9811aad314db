"""The stream over growing files: nothing lost, nothing twice, whatever the cuts."""

import json

import pytest

from causeway.sources import appended


def line(k, stream="app-logs", outcome="signal", ident=True):
    return json.dumps({"kind": "event", "stream": stream, "id": f"e{k}" if ident else None, "at": f"2024-01-01T00:{k // 60 % 60:02}:{k % 60:02}",
                       "outcome": outcome, "signal": {"n": k}})


def drain(spark, folder, work, once=False):
    rows = appended.recorded(spark, str(folder))
    rows = appended.once(rows).drop("event_time") if once else rows
    rows.writeStream.format("parquet").option("path", str(work / "out")).option("checkpointLocation", str(work / "cp")).trigger(
        availableNow=True).start().awaitTermination()
    return [r.id for r in spark.read.parquet(str(work / "out")).collect()]


def test_stop_grow_and_resume(spark, tmp_path):
    folder = tmp_path / "rec"
    folder.mkdir()
    a = folder / "a.jsonl"
    a.write_text("\n".join([json.dumps({"kind": "header", "version": 1}), line(1), line(2), "not json", line(3)[:-4]]))
    (folder / "_hidden").write_text(line(99) + "\n")
    assert sorted(drain(spark, folder, tmp_path)) == ["e1", "e2"]  # a torn last line waits
    with a.open("a") as f:
        f.write(line(3)[-4:] + "\n" + line(4) + "\n")
    (folder / "b.jsonl").write_text("\n".join(map(line, range(10, 20))) + "\n")
    assert sorted(drain(spark, folder, tmp_path)) == sorted(["e1", "e2", "e3", "e4", *[f"e{k}" for k in range(10, 20)]])
    assert len(drain(spark, folder, tmp_path)) == 14  # nothing new
    batch = appended.recorded(spark, str(folder), stream=False)
    assert batch.count() == 14
    points = {r.stream: r for r in appended.resume_points(batch).collect()}
    assert (points["app-logs"].events, points["app-logs"].last_id) == (14, "e19")


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_ranges_cut_anywhere(tmp_path, monkeypatch, size):
    monkeypatch.setattr(appended, "RANGE", size)
    monkeypatch.setattr(appended, "BLOCK", 11)
    texts = ["", "a", "bb" * 40, "é", "", "x y\r", "last"]
    raw = "".join(t + "\n" for t in texts).encode()
    (tmp_path / "f").write_bytes(raw + b"torn")
    full = appended.sizes(str(tmp_path), {})
    assert full == {"f": len(raw)}
    for start in (0, 1, 3):  # beginnings of lines
        rows = [r for p in appended.split({"f": start}, full) for b in appended.lines(str(tmp_path), p) for r in b.to_pylist()]
        kept = raw[start:].decode().split("\n")[:-1]
        assert [r["value"] for r in rows] == [t.removesuffix("\r") for t in kept]
        assert [raw[r["place"] : r["place"] + 1] for r in rows] == [(t + "\n").encode()[:1] for t in kept]


def test_a_shorter_file_is_an_error(tmp_path):
    (tmp_path / "f").write_text("a\nb\n")
    known = appended.sizes(str(tmp_path), {})
    (tmp_path / "f").write_text("a\n")
    with pytest.raises(ValueError, match="shorter"):
        appended.sizes(str(tmp_path), known)
    assert appended.sizes(str(tmp_path / "none"), {}) == {}


def test_repeats_of_a_reconnect_are_dropped(spark, tmp_path):
    folder = tmp_path / "rec"
    folder.mkdir()
    (folder / "a").write_text("\n".join([line(1), line(2), line(2), line(3, ident=False), line(3, ident=False)]) + "\n")
    first = drain(spark, folder, tmp_path, once=True)
    (folder / "b").write_text("\n".join([line(2), line(4), line(2, "dash-grafana")]) + "\n")
    got = drain(spark, folder, tmp_path, once=True)
    assert sorted(map(str, first)) == ["None", "None", "e1", "e2"]
    assert sorted(map(str, got)) == ["None", "None", "e1", "e2", "e2", "e4"]


def test_dispatch_and_replay(spark):
    log = "2024-01-01T00:00:00Z ERROR api pool [host:web-prod-1] connection refused"
    alarm = json.dumps({"AlarmName": "a", "NewStateValue": "ALARM", "StateChangeTime": "2024-01-01T00:00:00Z", "Trigger": {"MetricName": "m"}})
    dash = json.dumps({"title": "cpu", "state": "alerting"})
    rows = [("app-logs", log, 1), ("aws-cloudwatch", alarm, 2), ("dash-grafana", dash, 3), ("app-logs", "noise", 4), ("other", log, 5)]
    events = spark.createDataFrame(rows, "stream string, raw string, received_us long")
    assert sorted(r.source for r in appended.dispatched(events).collect()) == ["app_log", "cloudwatch_metric", "grafana_alert"]
    assert [r.stream for r in appended.unrouted(events).collect()] == ["other"]
    s = 1_000_000
    times = spark.createDataFrame([("a", k, "f", k) for k in (0, 5 * s, 10 * s, 12 * s, 500 * s)], "stream string, ts long, file string, place long")
    got = {r.ts // s: r.wait_s for r in appended.replay(times, 10 * s, 2.0, 60.0).collect()}
    assert got == {0: 0.0, 5: 0.0, 10: 0.0, 12: 1.0, 500: 30.0}
