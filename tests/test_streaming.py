"""The log over several runs: every line counts once, late and repeated rows as said."""

from __future__ import annotations

from tallyrun.streaming import log

SCHEMA = "k long, at timestamp, v string"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join('{"k": %d, "at": "2024-01-01T%s:00Z", "v": "%s"}\n' % r for r in rows))


def test_runs_take_up_where_the_last_ended(spark, tmp_path):
    path, run = tmp_path / "log", lambda: log.fold_newest(log.log_stream(spark, f"file://{path}", SCHEMA, 1), "k", "at", f"file://{tmp_path}/store", f"file://{tmp_path}/c")
    put(path, "a.json", [(1, "10:00", "a"), (2, "10:05", "b"), (1, "10:01", "c")])
    assert sorted((r["k"], r["v"]) for r in run().collect()) == [(1, "c"), (2, "b")]
    put(path, "b.json", [(1, "09:00", "old"), (3, "11:00", "d")])
    put(path, "c.json", [(2, "12:00", "e")])
    for _ in range(2):
        assert sorted((r["k"], r["v"]) for r in run().collect()) == [(1, "c"), (2, "e"), (3, "d")]


def test_windows_and_repeats(spark, tmp_path):
    path = tmp_path / "log"
    put(path, "a.json", [(1, "10:00", "a"), (1, "10:20", "a"), (2, "11:10", "b"), (2, "15:00", "b")])
    counted = log.window_counts(log.log_stream(spark, f"file://{path}", SCHEMA), "at", ["k"], "1 hour", "30 minutes")
    counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["start"].hour, r["k"], r["n"]) for r in spark.table("counted").collect()) == [(10, 1, 2), (11, 2, 1), (15, 2, 1)]
    once = log.once_within(log.log_stream(spark, f"file://{path}", SCHEMA), "at", ["k"], "6 hours")
    log.append_durably(once, f"file://{tmp_path}/once", f"file://{tmp_path}/c")
    assert sorted(r["k"] for r in spark.read.parquet(f"file://{tmp_path}/once").collect()) == [1, 2]
