import os
import random
from datetime import datetime, timedelta

from logquarry import dims
from logquarry.plans.feature_snapshot import FeatureSnapshot, around
from logquarry.plans.features import engineer_all
from logquarry.session import stage
from logquarry.sources.files import read_logs

START = datetime(2024, 3, 1, 5)


def line(rng, hour):
    at = START + timedelta(hours=hour, seconds=rng.choice([0, 59, 60, 1800, 3599]), milliseconds=rng.randrange(1000))
    level, service = rng.choice(["INFO", "ERROR", "WARNING"]), rng.choice(["nova-api", "nova-compute"])
    request = rng.choice(["aaaabbbb-cccc-4ddd-8eee-ffff00001111", "0f0e0d0c-1111-4222-8333-444455556666"])
    return (f"{service}.log.1.2024-03-01_05:00:00 {at:%Y-%m-%d %H:%M:%S}.{at.microsecond // 1000:03d} 1 {level} sample.module [req-{request}] "
            f"[instance: 12345678-9abc-4def-8123-00000000000{rng.randrange(3)}] step {rng.randrange(50)}")


def write(folder, name, seed, hours, n, at):
    rng = random.Random(seed)
    path = folder / name
    path.write_text("\n".join(line(rng, rng.choice(hours)) for _ in range(n)) + "\n")
    os.utime(path, (at, at))


def same_as_full(spark, kept, root):
    got = kept.features()
    want = engineer_all(read_logs(spark, str(root)), tiebreak=("source_file", "line_number"), materialize=stage)
    names = sorted(set(want.columns) - {"ingestion_time"})
    assert set(names) <= set(got.columns)
    a, b = stage(got.select(names)), stage(want.select(names))
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_add_change_and_delete(spark, tmp_path):
    root = tmp_path / "logs"
    root.mkdir()
    now = datetime.now().timestamp() - 1_000
    for hour in range(0, 30, 2):
        write(root, f"h{hour}.log", hour, [hour, hour + 1], 40, now)
    write(root, "sparse.log", 99, [40, 45, 50, 55], 6, now)
    kept = FeatureSnapshot(spark, str(tmp_path / "kept"))
    assert kept.features() is None
    first = kept.refresh(str(root))
    assert first["loaded"] == 16 and first["framed"] > 30
    same_as_full(spark, kept, root)
    assert kept.refresh(str(root)) == {"loaded": 0, "framed": 0}

    write(root, "new.log", 7, [10], 5, now + 1)  # one hour gets further lines
    write(root, "h20.log", 77, [20, 21], 12, now + 1)  # a file shrinks
    (root / "h4.log").unlink()  # two hours lose all their lines
    second = kept.refresh(str(root))
    assert second["loaded"] == 2 and 0 < second["framed"] < first["framed"] / 2
    same_as_full(spark, kept, root)


def test_neighbours_of_a_touched_span():
    counts = {1: 30, 2: 3, 3: 3, 5: 30, 6: 10, 7: 10, 9: 1, 10: 50, 11: 5}
    framed, context = around({5}, counts)
    assert framed == {3, 2, 5, 6, 7}  # four rows before look ahead into it, nineteen after look back
    assert context == {1, 9, 10}
    assert around({4}, counts)[0] == {2, 3, 5}  # a span that lost all its lines
    assert around(set(), {}) == (set(), set())


def test_tables_in_between_hold_what_is_asked_for(spark):
    """With ``only``, frames nobody needs are not written; the asked columns stay the same."""
    lines = spark.createDataFrame(
        [(i, datetime(2024, 1, 1, 0, 0, 7 * i % 60), ("INFO", "ERROR", None)[i % 3], f"svc{i % 2}", None if i % 5 == 0 else f"vm{i % 4}", f"req{i % 6}",
          f"failed {i}") for i in range(40)],
        "log_id long, timestamp timestamp_ntz, level string, service_type string, instance_id string, request_id string, message string")
    written = []
    only = engineer_all(lines, materialize=lambda df: written.append(df.columns) or stage(df), only=dims.MODEL_COLUMNS)
    assert "prev_level" not in written[0] and "instances_in_context_10" not in written[0] and "error_rate_last_5" in written[0]
    names = ["log_id", *dims.MODEL_COLUMNS]
    full = engineer_all(lines, materialize=stage)
    assert sorted(map(tuple, only.select(names).collect())) == sorted(map(tuple, full.select(names).collect()))
