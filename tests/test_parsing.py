from datetime import datetime

from pyspark.sql import functions as F

from logquarry.functions import parsing
from logquarry.sources.files import parse_lines, read_lines, rejected_lines

API = ('nova-api.log.1.2021-03-02_09:10:11 2021-03-02 07:00:00.250 412 INFO sample.api.server '
       '[req-0f0e0d0c-1111-4222-8333-444455556666] 192.0.2.7 "GET /v2/things HTTP/1.1" status: 200')
COMPUTE = ('nova-compute.log.1.2021-03-02_09:10:12 2021-03-02 07:00:04.500 977 INFO sample.compute.worker '
           '[req-aaaabbbb-cccc-4ddd-8eee-ffff00001111] [instance: 12345678-9abc-4def-8123-456789abcdef] '
           'machine is up')
SEVEN_DIGITS = COMPUTE.replace("04.500 ", "04.5000000 ")
MARKED = COMPUTE + " \u0001 odd \u0001 bytes"
REJECTS = ["  File \"manager.py\", line 12, in run", "nova-api.log 2021-03-02 07:00:00.250 1 INFO mod no brackets", "   ",
           "\u0001" * 9]


def parsed(spark, *lines):
    return parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()


def test_fields_of_a_line(spark):
    row = parsed(spark, COMPUTE)[0]
    assert row.service_type == "nova-compute"
    assert row.level == "INFO"
    assert row.process_id == "977"
    assert row.module == "sample.compute.worker"
    assert row.request_id == "aaaabbbb-cccc-4ddd-8eee-ffff00001111"
    assert row.instance_id == "12345678-9abc-4def-8123-456789abcdef"
    assert row.message.startswith("[instance: 12345678")
    assert row.timestamp == datetime(2021, 3, 2, 7, 0, 4, 500000)


def test_missing_parts_are_null(spark):
    row = parsed(spark, API)[0]
    assert row.instance_id is None and row.service_type == "nova-api"


def test_rejected_and_odd_lines(spark):
    assert parsed(spark, *REJECTS) == []
    assert parsed(spark, SEVEN_DIGITS)[0].timestamp is None
    assert parsed(spark, MARKED)[0].message.endswith("\u0001 odd \u0001 bytes")
    lines = spark.createDataFrame([(x,) for x in [COMPUTE, *REJECTS]], "value string")
    assert rejected_lines(lines).count() == 3


def test_flexible_timestamps(spark):
    texts = ["2017-05-16 01:02:03.5", "2017-05-16T01:02:03", "16/05/2017 01:02:03", "2017-05-16", "soon", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(parsing.flexible_timestamp(F.col("t")))
    got = [r[0] for r in df.collect()]
    assert got[0] == datetime(2017, 5, 16, 1, 2, 3, 500000)
    assert got[1] == got[2] == datetime(2017, 5, 16, 1, 2, 3)
    assert got[3] == datetime(2017, 5, 16)
    assert got[4] is None and got[5] is None


def test_line_numbers_over_many_splits(spark, tmp_path):
    expected = {}
    for name, count in (("a.log", 5000), ("sub/b.txt", 700), ("sub/c.log", 1)):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        lines = ["" if i % 7 == 3 else f"  line {i} of {name}  " for i in range(1, count + 1)]
        path.write_text("\n".join(lines) + "\n")
        expected |= {(name.split("/")[-1], i): line.strip() for i, line in enumerate(lines, 1) if line.strip()}
    (tmp_path / "skip.csv").write_text("not a log\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r.source_file.split("/")[-1], r.line_number): r.value for r in rows} == expected
    assert len(rows) == len(expected)


def test_undecodable_bytes_are_dropped(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"good \xff\xfe line\n")
    assert read_lines(spark, str(tmp_path)).first().value == "good  line"


def test_lines_are_stripped_and_cut_once(spark, tmp_path):
    from logquarry.sources.files import read_logs

    (tmp_path / "a.log").write_text("\n  \nnova.log 2024-01-01 00:00:00.123456 1 INFO m.n [req-1] text \nno line\n")
    got = read_logs(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    conditions = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]
    assert conditions and not any("regexp" in c.lower() or "rlike" in c.lower() for c in conditions)
    assert [(r.line_number, r.raw_log[-4:]) for r in got.collect()] == [(3, "text")]
