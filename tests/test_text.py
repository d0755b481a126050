import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logquarry.functions import text
from logquarry.functions.chunking import chunk, chunk_bounds
from logquarry.operators.documents import new_documents, to_documents


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(2, 60), st.integers(0, 59))
def test_chunks_end_and_cover_the_text(body, size, overlap):
    bounds = list(chunk_bounds(body, size, overlap))
    starts = [a for a, _ in bounds]
    assert starts == sorted(set(starts))
    covered = set()
    for a, b in bounds:
        covered |= set(range(a, min(b, len(body))))
    missing = [i for i in range(len(body)) if i not in covered]
    # Only where the next start jumps over the cut (overlap below the jump) may blanks be left out.
    assert all(body[i] == " " for i in missing)


def test_chunk_of_one_blank_and_limits(spark):
    long = "a" * 10 + " " + "b" * 2000
    rows = spark.createDataFrame([("",), ("x" * 512,), ("x" * 513,), (long,), (None,)], "t string")
    got = [r[0] for r in rows.select(chunk(F.col("t"))).collect()]
    assert got[0] == [""] and got[1] == ["x" * 512]
    assert got[2][0] == "x" * 512
    assert got[3][0] == "a" * 10 and "".join(got[3]).count("b") >= 2000
    assert got[4] == []


def test_truncate(spark):
    cases = ["short", "w " * 600, "x" * 1500, "y" * 700 + " " + "z" * 900]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "t string").select(text.truncate(F.col("t"))).collect()]
    assert got[0] == "short"
    assert got[1] == ("w " * 600)[:999] + "..."
    assert got[2] == "x" * 1000 + "..."
    assert got[3] == cases[3][:1000] + "..."


def test_terms_keep_order_and_pairs(spark):
    row = spark.createDataFrame([("The Disk is full, disk full",), ("one",), (None,)], "t string").select(
        text.terms(F.col("t")).alias("x")).collect()
    assert row[0].x == ["disk", "full", "disk", "full", "disk full", "full disk", "disk full"]
    assert row[1].x == ["one"] and row[2].x == []


def test_documents_and_reingest(spark):
    rng = random.Random(3)
    body = " ".join("w" * rng.randint(2, 9) for _ in range(160))
    logs = spark.createDataFrame(
        [(1, None, "nova-api", "INFO", "short message", "i-1"), (2, None, "nova-api", "INFO", body, None)],
        "log_id long, timestamp timestamp_ntz, service_type string, level string, message string, instance_id string")
    whole, pieces = to_documents(logs), to_documents(logs, chunking=True)
    assert whole.count() == 2
    rows = pieces.orderBy("log_id", "chunk_index").collect()
    assert rows[0].document == "nova-api INFO: short message [Instance: i-1]" and not rows[0].is_chunked
    long = [r for r in rows if r.log_id == 2]
    assert len(long) == long[0].total_chunks > 1 and all(r.is_chunked for r in long)
    assert new_documents(pieces.unionByName(pieces), pieces.where("log_id = 1")).count() == len(long)
