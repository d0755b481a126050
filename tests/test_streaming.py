from pyspark.sql import functions as F

from logquarry.catalog.views import raw_lines
from logquarry.operators.sequence import error_burst, sequence_features
from logquarry.sources.files import parse_lines
from logquarry.streaming import jobs


def write_in_order(spark, sf, root, parts=4):
    """The raw lines as files, each later in time than the one before."""
    rows = [r.line for r in raw_lines(spark, sf).orderBy("log_id").collect()]
    size = -(-len(rows) // parts)
    for i in range(parts):
        (root / f"part{i}.log").write_text("\n".join(rows[i * size:(i + 1) * size]) + "\n")
        import os
        os.utime(root / f"part{i}.log", (1_700_000_000 + i * 100, 1_700_000_000 + i * 100))
    return len(rows)


def test_bursts_over_micro_batches(spark, sf, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    count = write_in_order(spark, sf, root)
    detector = jobs.BurstDetector(str(tmp_path / "out"), tiebreak=("raw_log",))
    stream = jobs.read_stream(spark, str(root), max_files=1)
    detector.start(stream, str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    got = detector.table(spark).select("raw_log", "error_burst", "is_error_burst")
    batch = parse_lines(spark.read.text(str(root)))
    want = sequence_features(batch, error_burst, tiebreak=("raw_log",)).select("raw_log", "error_burst", "is_error_burst")
    assert got.count() == count
    assert got.exceptAll(want).count() == 0


def line(second, level, text="x"):
    return (f"nova-api.log.1.2024-01-01_00:00:00 2024-01-01 00:{second // 60:02d}:{second % 60:02d}.000000 7 {level} "
            f"nova.compute.manager [-] {text}")


def run_loads(spark, tmp_path, loads, lateness):
    """Each load is one file, one run of the stream and one batch."""
    (tmp_path / "in").mkdir()
    detector = jobs.BurstDetector(str(tmp_path / "out"), tiebreak=("raw_log",), lateness=lateness)
    for i, load in enumerate(loads):
        (tmp_path / "in" / f"{i}.log").write_text("\n".join(load) + "\n")
        detector.start(jobs.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "checkpoint"),
                       available_now=True).awaitTermination()
    return detector


def frames(lines):
    """Errors among the last ten lines in order of time, by hand."""
    lines = sorted(lines, key=lambda x: x.split(" 7 ")[0][-26:] + x)
    return sorted((x, float(sum(" 7 ERROR" in y for y in lines[max(i - 9, 0):i + 1]))) for i, x in enumerate(lines))


def result(detector, spark):
    return sorted((r.raw_log, r.error_burst) for r in detector.table(spark).collect())


def test_bursts_of_rows_out_of_order(spark, tmp_path):
    """Within the lateness any order of arrival gives the frames of one batch; equal times and equal lines too."""
    rows = [line(s // 2, "ERROR" if s % 3 else "INFO", f"row {s // 4}") for s in range(0, 240, 2)]
    loads = [rows[20:60] + rows[:5], rows[5:20] + rows[70:90] + rows[5:7], rows[60:70] + rows[90:]]
    detector = run_loads(spark, tmp_path, loads, "90 seconds")
    assert detector.late(spark).count() == 0
    assert result(detector, spark) == frames([x for load in loads for x in load])
    released = spark.read.parquet(str(tmp_path / "out" / "rows")).count()
    assert 0 < released < len(rows)
    assert not (tmp_path / "out" / "state" / "batch=0").exists()


def test_bursts_and_rows_behind_the_watermark(spark, tmp_path):
    """Rows too late are kept apart and change no frame; a batch that is repeated changes nothing."""
    first, second = [line(s, "ERROR") for s in range(0, 100, 5)], [line(7, "ERROR"), line(200, "INFO")]
    detector = run_loads(spark, tmp_path, [first, second], "10 seconds")
    want = frames(first + second[1:])
    assert result(detector, spark) == want
    assert [r.raw_log for r in detector.late(spark).collect()] == second[:1]
    again = parse_lines(spark.createDataFrame([(x,) for x in second], "value string").withColumn(
        "source_file", F.lit("again")))
    detector(again.select(*detector.late(spark).columns), 1)
    assert result(detector, spark) == want and detector.late(spark).count() == 1


def test_bursts_of_an_empty_batch(spark, tmp_path):
    detector = jobs.BurstDetector(str(tmp_path / "out"), tiebreak=("raw_log",))
    rows = parse_lines(spark.createDataFrame([(line(1, "ERROR"),)], "value string"))
    detector(rows.limit(0), 0)
    assert detector.table(spark).count() == 0
    untimed = rows.withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))
    detector(rows.unionByName(untimed), 1)
    assert sorted(r.error_burst for r in detector.table(spark).collect()) == [1.0, 2.0]


def test_instance_statistics_in_update_mode(spark, sf, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    write_in_order(spark, sf, root, parts=2)
    stream = jobs.instance_statistics(jobs.read_stream(spark, str(root)), period="365 days")
    query = stream.writeStream.format("memory").queryName("per_instance").outputMode("update").trigger(
        availableNow=True).start()
    query.awaitTermination()
    got = spark.table("per_instance").groupBy("instance_id").agg(F.max("n").alias("n"))
    batch = parse_lines(spark.read.text(str(root))).where("instance_id is not null").groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("n"))
    assert got.exceptAll(batch).count() == 0 and got.count() == batch.count()
