import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekrank import schemas
from weekrank.sources import landed
from weekrank.streaming import ingest

def land(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in records))


def play(artist, at):
    return {"artist_name": artist, "track_name": "t", "date": at}


def test_stream_appends_once_and_a_repeated_batch_changes_nothing(spark, tmp_path, rows):
    folder, path, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    known = str(tmp_path / "known")
    order = ["date", "artist_name"]

    def store(batch, number):
        ingest.append_new_rows(batch, path, number, order)

    def lookup(batch, number):
        ingest.append_unseen(batch, known, number, ["artist_name"], lambda d: d.withColumn("found", F.upper("artist_name")))

    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("artist_name", "track_name", "date")])

    def run():
        ingest.each_batch(ingest.watch(spark, str(folder), schema), state, store, lookup).start().awaitTermination()
        return rows(spark.read.parquet(path), "scrobble_number", "artist_name", "date")

    land(folder, "a.json", [play("x", "2021-01-01 10:00:00"), play("y", "2021-01-01 09:00:00")])
    first = run()
    assert first == [(1, "y", "2021-01-01 09:00:00"), (2, "x", "2021-01-01 10:00:00")]
    # A late row (not after the high-water mark) is not taken; numbers go on.
    land(folder, "b.json", [play("z", "2021-01-02 00:00:00"), play("late", "2021-01-01 10:00:00"), play("x", "2021-01-03 00:00:00")])
    second = run()
    assert second == [*first, (3, "z", "2021-01-02 00:00:00"), (4, "x", "2021-01-03 00:00:00")]
    assert run() == second
    # The second batch once more, as after a failure between the write and the commit.
    again = spark.read.schema(schema).json(str(folder / "b.json"))
    store(again, 1)
    lookup(again, 1)
    assert rows(spark.read.parquet(path), "scrobble_number", "artist_name", "date") == second
    assert rows(spark.read.parquet(known), "artist_name", "found", ingest.BATCH) == [
        ("late", "LATE", 1), ("x", "X", 0), ("y", "Y", 0), ("z", "Z", 1)]


def test_labels_merge(spark, tmp_path, rows):
    def pages(*picks):
        body = {"items": [{"added_at": at, "track": {"id": i, "name": "n", "artists": [{"name": "a"}]}} for i, at in picks]}
        return spark.createDataFrame([(json.dumps(body),)], "payload string")

    path, keys = str(tmp_path / "labels"), ["artist_name", "track_name", schemas.WEEK]
    for batch in (pages(("1", "2021-01-02T10:00:00Z"), ("2", "2021-01-16T10:00:00Z")), pages(("3", "2021-01-03T10:00:00Z")), pages(("3", "2021-01-03T10:00:00Z"))):
        ingest.merge_labels(landed.favorites(batch), path, keys, ["added_at_utc", "spotify_track_id"], schemas.WEEK)
    got = [(r["spotify_track_id"], str(r[schemas.WEEK])) for r in spark.read.parquet(path).orderBy(schemas.WEEK).collect()]
    assert got == [("3", "2021-01-02"), ("2", "2021-01-16")]


def test_new_rows_bounds(spark, rows):
    stored = spark.createDataFrame([("2021-01-01 00:00:00",)], "date string")
    incoming = spark.createDataFrame([("2021-01-01 00:00:00",), ("2021-01-02 00:00:00",), ("2021-01-09 00:00:00",)], "date string")
    assert rows(ingest.new_rows(incoming, stored, until="2021-01-02 00:00:00")) == [("2021-01-02 00:00:00",)]
    assert ingest.new_rows(incoming, None).count() == 3


def test_empty_first_batch(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-06 10:00:00", "a")], "date string, name string")
    ingest.append_new_rows(rows.limit(0), str(tmp_path / "t"), 0, ["date"])
    ingest.append_new_rows(rows, str(tmp_path / "t"), 1, ["date"])
    assert [(r["name"], r["scrobble_number"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [("a", 1)]


@pytest.mark.parametrize("files", [1, 3])
@pytest.mark.parametrize("backwards", [False, True])
def test_the_log_holds_every_row_whatever_the_order(spark, tmp_path, rows, files, backwards):
    days = [[play(f"d{d}", f"2021-01-0{d} 10:00:00"), play("both", "2021-01-05 10:00:00"), play(None, None)] for d in range(1, 7)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("artist_name", "track_name", "date")])
    folder, path, state = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "state")
    keys = ["artist_name", "track_name", "date"]

    def store(batch, number):
        ingest.log_rows(batch, path, number, keys)

    landed_days = days[::-1] if backwards else days
    for half in (landed_days[:3], landed_days[3:]):  # stopped in the middle and started again
        for day in half:
            land(folder, f"{len(list(folder.glob('*'))) if folder.exists() else 0}.json", day)
        ingest.each_batch(ingest.watch(spark, str(folder), schema, files_per_trigger=files), state, store).start().awaitTermination()
    got = rows(ingest.numbered(spark, path, ["date", "artist_name"]).select("scrobble_number", "artist_name", "date"))
    want = sorted([("", None)] + [(f"2021-01-0{d} 10:00:00", f"d{d}") for d in range(1, 7)] + [("2021-01-05 10:00:00", "both")])
    assert [(r[2] or "", r[1]) for r in got] == want and [r[0] for r in got] == list(range(1, 9))
    log = ingest.commits(spark, path).orderBy(ingest.BATCH).collect()
    assert sum(r.n for r in log) == 8 and sum(r.n_late for r in log) > 0
    # The first batch once more, as after a failure between the write and the commit.
    first = rows(spark.read.parquet(path).filter(f"{ingest.BATCH} = 0"))
    names = [name for name in folder.glob("*") if any(f'"{r[0]}"' in name.read_text() for r in first if r[0] not in (None, "both"))]
    store(spark.read.schema(schema).json([str(n) for n in names]), 0)
    assert rows(spark.read.parquet(path).filter(f"{ingest.BATCH} = 0")) == first


def test_weekly_window_gives_a_week_out_once(spark, tmp_path, rows):
    schema = T.StructType([T.StructField("artist_name", T.StringType()), T.StructField("date", T.TimestampType())])
    folder, path, state = tmp_path / "in", str(tmp_path / "weeks"), str(tmp_path / "state")

    def run():
        counts = ingest.weekly_counts(ingest.watch(spark, str(folder), schema, files_per_trigger=1), ["artist_name"], "date", "2 days")
        counts.writeStream.option("checkpointLocation", state).format("parquet").option("path", path).trigger(availableNow=True).start().awaitTermination()
        return rows(spark.read.schema("artist_name string, week_saturday date, n long").parquet(path))

    land(folder, "a.json", [play("x", "2021-01-03 00:00:00"), play("x", "2021-01-09 23:59:59"), play("x", "2021-01-10 00:00:00")])
    assert run() == []
    land(folder, "b.json", [play("x", "2021-01-11 23:00:00"), play("x", "2021-01-04 00:00:00")])
    assert run() == []
    land(folder, "c.json", [play("y", "2021-01-13 00:00:00")])
    assert [(a, str(w), n) for a, w, n in run()] == [("x", "2021-01-09", 3)]
    land(folder, "d.json", [play("x", "2021-01-05 00:00:00"), play("y", "2021-01-25 00:00:00")])
    assert sorted((a, str(w), n) for a, w, n in run()) == [("x", "2021-01-09", 3), ("x", "2021-01-16", 2), ("y", "2021-01-16", 1)]
