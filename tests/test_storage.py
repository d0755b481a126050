import time

import pytest
from pyspark.sql import functions as F

from logquarry.catalog.views import logs, table
from logquarry.functions.vectors import hashed_words, hashing_encoder
from logquarry.operators.documents import to_documents
from logquarry.operators.anomaly import model_matrix
from logquarry.operators.labels import MODEL_INPUT, apply_labels, classic_matrix, fit_labels
from logquarry.operators.model import ImportanceModel, stratified_split
from logquarry.sources.snapshot import LogSnapshot, changed_files, expire, inventory, load_first_available
from logquarry.sources.store import DocumentStore, export_rows, load_logs, read_rows, save_logs
from test_parsing import API, COMPUTE


def test_snapshot_loads_changes_only(spark, tmp_path):
    root, kept = tmp_path / "logs", LogSnapshot(spark, str(tmp_path / "kept"))
    root.mkdir()
    (root / "a.log").write_text(f"{API}\n{COMPUTE}\nnoise\n")
    (root / "b.log").write_text(f"{API}\n")
    assert kept.read() is None
    assert kept.refresh(str(root)) == 2
    assert kept.refresh(str(root)) == 0
    assert kept.read().count() == 3
    time.sleep(1.1)
    (root / "b.log").write_text(f"{API}\n{COMPUTE}\n{COMPUTE}\n")
    assert kept.refresh(str(root)) == 1
    assert kept.read().count() == 5
    facts = inventory(kept.manifest()).first()
    assert (facts.entries, facts.rows) == (2, 5)
    assert expire(kept.manifest(), 0).count() == 0
    listing = kept.manifest().select("path", "size", "mtime")
    assert changed_files(listing, kept.manifest(), 24).count() == 0
    assert changed_files(listing, kept.manifest(), 0).count() == 2


def test_document_store(spark, sf, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "docs"))
    docs = to_documents(logs(spark, sf))
    store.add(docs.limit(10))
    store.add(docs)
    store.add(docs)
    assert store.read().count() == docs.count()
    assert store.read().where("instance_id = 'None'").count() == 0
    store.clear()
    assert store.read().count() == 0


def test_embeddings_are_stored_once(spark, tmp_path):
    """The expression gives what the Arrow encoder gives; ingest keeps vectors that came along and repeats none."""
    texts = ["Disk full on node_7, disk failing", "", None, "the of and", "x", "Ünïcode wörds 42 42", "word " * 3000]
    df = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, document string")
    for r in df.select(hashed_words(F.col("document"), 16).alias("a"), hashing_encoder(16)(F.col("document")).alias("b")).collect():
        assert r.a == pytest.approx(r.b, abs=1e-12) and len(r.a) == 16
    store = DocumentStore(spark, str(tmp_path / "docs"), lambda text: hashed_words(text, 16))
    given = df.where("doc_id = 'd0'").withColumn("embedding", F.array_repeat(F.lit(0.25).cast("float"), 16))
    store.add(given)
    store.add(df)
    store.add(df)
    rows = {r.doc_id: r.embedding for r in store.read().collect()}
    assert store.read().count() == len(texts) == len(rows) and rows["d0"] == [0.25] * 16
    assert sum(x * x for x in rows["d6"]) == pytest.approx(1) and not any(rows["d1"]) and not any(rows["d2"])


def test_hybrid_analysis_with_stored_vectors(spark, sf):
    """Vectors from a column give the answers that encoding at each call gives."""
    from logquarry.catalog.views import issues
    from logquarry.plans.analysis import analyze_issues

    lines = logs(spark, sf)
    again = analyze_issues(lines, issues(spark), "hybrid", hashing_encoder(16))
    stored = analyze_issues(lines.withColumn("vec", hashed_words(F.col("message"), 16)), issues(spark), "hybrid",
                            hashing_encoder(16), embedding="vec")
    assert sorted(map(str, stored.collect())) == sorted(map(str, again.collect()))


def test_save_and_load(spark, sf, tmp_path):
    df = logs(spark, sf)
    for name in ("x.parquet", "x.csv"):
        save_logs(df, str(tmp_path / name))
        back = load_logs(spark, str(tmp_path / name), df.schema)
        assert back.exceptAll(df).count() == 0 and back.count() == df.count()
    with pytest.raises(ValueError):
        save_logs(df, str(tmp_path / "x.pkl"))


def test_first_available_source(spark):
    some = spark.range(1)
    assert load_first_available([lambda: None, lambda: some.limit(0), lambda: some]) is some
    assert load_first_available([lambda: None]) is None


def test_unseen_label_is_an_error(spark):
    seen = spark.createDataFrame([("a",), (None,)], "x string")
    codes = fit_labels(seen, "x")
    assert {r.value: r.code for r in codes.collect()} == {"a": 0, "unknown": 1}
    new = spark.createDataFrame([("b",)], "x string")
    with pytest.raises(Exception, match="unseen value"):
        apply_labels(new, codes, "x").collect()
    assert apply_labels(new, codes, "x", on_unseen="null").first().x_encoded is None


def test_model_round_trip(spark, sf, tmp_path):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    split = stratified_split(rows, "doc_id", "quality")
    assert split.where("is_test").count() + split.where("not is_test").count() == rows.count()
    model = ImportanceModel.train(rows, "text", "quality", max_iter=5)
    model.save(str(tmp_path / "model"))
    again = ImportanceModel.load(str(tmp_path / "model"))
    first = model.score(rows, "text").select("doc_id", F.round("importance", 9).alias("p"))
    second = again.score(rows, "text").select("doc_id", F.round("importance", 9).alias("p"))
    assert first.exceptAll(second).count() == 0
    assert first.where("p < 0 or p > 1").count() == 0


def test_model_inputs(spark, sf):
    rows = spark.createDataFrame([(1, 2.0, None, 7), (2, 4.0, 1, 7), (3, None, 1, 7)], "log_id long, a double, b int, c int")
    got = {r.log_id: (round(r.a, 4), round(r.b, 4), r.c) for r in model_matrix(rows, columns=["a", "b", "c"]).collect()}
    assert got == {1: (0.0, -1.4142, 0.0), 2: (1.2247, 0.7071, 0.0), 3: (-1.2247, 0.7071, 0.0)}
    lines = logs(spark, sf).withColumn("module", F.lit(None).cast("string"))
    train, rest = lines.where("log_id % 2 = 0"), lines.where("log_id % 2 = 1")
    matrix = classic_matrix(rest, labels={c: fit_labels(train, c) for c in ("level", "service_type", "module")})
    assert matrix.columns[1:11] == MODEL_INPUT and len(matrix.columns) == 21 and matrix.count() == rest.count()
    assert matrix.where("module_encoded <> 0").count() == 0


def test_export_keeps_odd_values(spark, tmp_path):
    """Line ends, quotes, separators, spaces at the ends, empty texts, nulls, nested columns, no rows."""
    texts = ["a\nb", "a\r\nb", '"quoted", "more"', "  wide  ", "", None, "back\\slash", "x" * 200_000, "a\nb"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").withColumns({
        "at": F.lit("2024-01-05 00:00:01.000007").cast("timestamp_ntz"), "seen": F.array("id", F.lit(None).cast("long"))})
    path = str(tmp_path / "rows")
    export_rows(rows, path)
    schema = "id long, text string, at timestamp_ntz, seen string"
    got = read_rows(spark, path, schema).orderBy("id").collect()
    assert [r.text for r in got] == texts
    assert got[3].seen == "[3,null]" and got[0]["at"] == rows.first()["at"]
    export_rows(rows.where("id > 2"), path, ["text", "id"])
    assert read_rows(spark, path, "text string, id long").count() == 6
    export_rows(rows.limit(0), path)
    assert read_rows(spark, path, schema).count() == 0


def test_row_digest_tells_rows_apart(spark):
    from logquarry.catalog.sources import row_digest

    shape = "a string, b string, x double, y array<string>"
    rows = spark.createDataFrame([
        ("", None, 0.0, ["p", "q"]), (None, "", 0.0, ["p", "q"]), ("", None, 1.0, ["p", "q"]), ("", None, 0.0, ["p, q"]),
        ('a","b', "c", None, None), ("a", 'b","c', None, None), ("", None, -0.0, ["p", "q"])], shape)
    got = [r[0] for r in rows.select(row_digest(rows)).collect()]
    assert len(set(got)) == 6 and got[0] == got[6]
