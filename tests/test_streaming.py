import json
from datetime import datetime

from tianguis.streaming import captures


def write(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")


def row(i, day, **more):
    return {"observation_id": f"o{i}", "source_id": "s", "listing_id": str(i), "title": "x", "price": 10.0 + i, "currency": "CUP", "seller": f"v{i}", "captured_at": f"2026-{day}T10:00:00Z", **more}


def test_history_of_a_stream_across_batches(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()
    for name, rows in (("a.json", [row(1, "08-25"), row(1, "08-25")]), ("b.json", [row(2, "09-02"), row(1, "08-25")])):
        write(folder, name, rows)
        captures.keep_history(captures.unique_captures(captures.capture_stream(spark, str(folder), 1)), out, mark).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 2 and "capture_date" in got.columns


def test_weeks_begin_on_monday_and_wait_for_the_watermark(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, "a.json", [row(1, "08-25"), row(2, "09-02"), row(3, "09-29")])
    write(folder, "b.json", [row(4, "09-30")])
    weeks = captures.weekly_supply(captures.unique_captures(captures.capture_stream(spark, str(folder), 1)))
    q = weeks.writeStream.format("memory").queryName("weeks").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.period_start: r.listing_count for r in spark.table("weeks").collect()}
    assert got == {datetime(2026, 8, 24): 1, datetime(2026, 8, 31): 1}


def test_touched_periods_are_recomputed(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    write(folder, "a.json", [row(1, "08-25"), row(2, "08-26"), row(3, "09-29")])
    captures.refresh_periods(captures.capture_stream(spark, str(folder)), str(tmp_path / "c"), lambda p, n: seen.append(sorted(str(r.period) for r in p.collect()))).awaitTermination()
    assert seen == [["2026-08-24 00:00:00", "2026-09-28 00:00:00"]]
