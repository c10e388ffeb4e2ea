import os

import pytest
from pyspark.sql import functions as F

from dqspark.lineage import scratch_path, shared_dir
from dqspark.operators.scorecard import scorecard
from dqspark.operators.tables import exists_in, first_rows, keep_best, one_of, quarantine, required, upsert_latest
from dqspark.plans.actions import INTENT_DDL, PLAN_DDL, approved, read_plan, vet_intents, vet_plan
from dqspark.sources.audit import append_log, log_entries, read_log
from dqspark.sources.files import (
    changed_files,
    dataset_profile,
    detect_delimiters,
    detect_encodings,
    fingerprints,
    read_delimited,
    read_table,
    write_table,
)


def test_keep_best(spark):
    rows = [
        (1, "bar", ["a", "b"], 3.0),
        (2, "bar", ["b", "a"], 4.0),
        (3, "bar", ["a", "b", "a"], 4.0),
        (4, "box", ["a"], 4.0),
        (5, "pie", ["a"], 2.4),
        (6, "pie", ["b"], 2.5),
    ]
    df = spark.createDataFrame(rows, "seq int, chart string, cols array<string>, score double")
    got = keep_best(df, ["chart", F.array_sort(F.array_distinct("cols"))], "score", "seq").collect()
    assert [r.seq for r in got] == [2, 4, 6]


def test_upsert(spark):
    ddl = "seq int, k string, v int"
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], ddl)
    new = spark.createDataFrame([(1, "c", 2), (2, "a", 2), (3, "a", 3)], ddl)
    got = upsert_latest(old, new, ["k"], "seq").orderBy("first_side", "first_seq").collect()
    assert [(r.k, r.v) for r in got] == [("a", 3), ("b", 1), ("c", 2)]


def test_quarantine(spark):
    df = spark.createDataFrame([(1, "x", 1), (2, "y", 9), (3, None, 1), (4, "x", None)], "id int, k string, r int")
    known = spark.createDataFrame([(1,), (1,), (2,)], "key int")
    rules = [required("k", "no_k"), one_of("k", ["x"], "bad_k"), exists_in("r", known, "key", "bad_r")]
    accepted, rejected = quarantine(df, rules)
    assert [r.id for r in accepted.collect()] == [1]
    assert {r.id: r.reasons for r in rejected.collect()} == {
        2: ["bad_k", "bad_r"],
        3: ["no_k", "bad_k"],
        4: ["bad_r"],
    }


def test_first_rows(spark):
    df = spark.createDataFrame([(3,), (None,), (1,), (2,)], "x int")
    assert [r.x for r in first_rows(df, ["x"], 3).collect()] == [1, 2, 3]


def test_plans_are_vetted_and_read(spark):
    rows = [
        (1, "age", "impute_mean", "gaps", None),
        (2, "age", "magic_fix", "?", None),
        (3, "age", "drop_rows", None, None),
        (4, "gone", "drop_rows", "gaps", None),
        (5, "age", "cap_outliers", "far", (None, None, 0.9)),
    ]
    plan = spark.createDataFrame(rows, PLAN_DDL).withColumn("dataset_id", F.lit(1))
    catalogue = spark.createDataFrame([(1, "age"), (2, "gone")], "dataset_id int, column string")
    vetted = vet_plan(plan, catalogue)
    assert {r.seq: r.reason for r in vetted.collect()} == {
        1: None,
        2: "rejected_invalid_action",
        3: "rejected_invalid_action",
        4: "rejected_nonexistent_column",
        5: None,
    }
    good = vetted.where("reason IS NULL")
    assert [(a.seq, dict(a.params)) for a in read_plan(good)] == [(1, {}), (5, {"cap_percentile": 0.9})]
    turned_down = spark.createDataFrame([(1,)], "seq int")
    assert [a.seq for a in read_plan(approved(good, turned_down))] == [5]


def test_intents_are_vetted(spark):
    rows = [
        (1, "bar", ["k", "n"], "why", 4.0, "c"),
        (2, "treemap", ["k"], "why", 4.0, "c"),
        (3, "bar", ["k"], "why", 5.1, "c"),
        (4, "bar", ["k"], "why", -0.1, "c"),
        (5, "bar", ["gone"], "why", 1.0, "c"),
        (6, "bar", ["n"], "why", 1.0, "c"),
        (7, "heatmap", ["n"], "why", 1.0, "c"),
        (8, "heatmap", ["n", "n2"], "why", 1.0, "c"),
        (9, "line", ["t", "n"], "why", 1.0, "c"),
        (10, "line", ["n", "t"], "why", 1.0, "c"),
        (11, "pie", None, "why", 1.0, "c"),
        (12, "scatter", [], "why", 1.0, "c"),
    ]
    intents = spark.createDataFrame(rows, INTENT_DDL).withColumn("dataset_id", F.lit(1))
    kinds = [("k", "categorical"), ("n", "numeric"), ("n2", "numeric"), ("t", "datetime")]
    catalogue = spark.createDataFrame([(1, *k) for k in kinds], "dataset_id int, column string, class string")
    got = {r.seq: r.reason for r in vet_intents(intents, catalogue).collect()}
    bad, lost, unfit = "rejected_invalid_intent", "rejected_nonexistent_columns", "rejected_dtype_incompatible"
    assert got == {
        1: None, 2: bad, 3: bad, 4: bad, 5: lost, 6: unfit, 7: unfit, 8: None, 9: None, 10: unfit, 11: bad, 12: unfit,
    }


def test_scorecard(spark):
    checks = spark.createDataFrame([("r", "verified"), ("r", "flagged"), ("s", "failed")], "run_id string, status string")
    diffs = spark.createDataFrame([("r",)], "run_id string")
    audit = spark.createDataFrame([("r",), ("t",)], "run_id string")
    got = {r.run_id: tuple(r)[1:] for r in scorecard(checks, diffs, audit).collect()}
    assert got == {"r": (2, 1, 1, 0, 1, 1), "s": (1, 0, 0, 1, 0, 0), "t": (0, 0, 0, 0, 0, 1)}


def test_audit_trail_is_append_only_and_ordered(spark):
    path = scratch_path(spark, "log")
    append_log(log_entries(spark, "r1", [("ingest", "code", "loaded", {"rows": 3})]), path)
    append_log(log_entries(spark, "r1", [("plan", "llm", "proposed", {})], start=1), path)
    append_log(log_entries(spark, "r2", [("ingest", "code", "loaded", {})]), path)
    log = read_log(spark, path).where("run_id = 'r1'").orderBy("seq").collect()
    assert [(r.seq, r.actor, r.detail) for r in log] == [(0, "code", '{"rows": 3}'), (1, "llm", "{}")]
    assert read_log(spark, path).count() == 3
    with pytest.raises(ValueError):
        log_entries(spark, "r1", [("ingest", "human", "x", {})])


@pytest.fixture
def folder(tmp_path):
    def write(name, data):
        path = tmp_path / name
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
        return str(path)

    return tmp_path, write


def test_delimiters_per_file(spark, folder):
    path, write = folder
    write("a.csv", "x;y\n1;2,5\n3;4\n")
    write("b.tsv", "x\ty\n1\t2\n")
    write("c.txt", "just one\ncolumn here\n")
    write("d.csv", 'k,v\n"a|b",1\n"c|d",2\n')
    got = {os.path.basename(r.file): r.delimiter for r in detect_delimiters(spark, str(path)).collect()}
    assert got == {"a.csv": ";", "b.tsv": "\t", "c.txt": ",", "d.csv": ","}


def test_encodings_and_scan(spark, folder):
    path, write = folder
    latin = write("latin.csv", "näme;wert\nzoë;1,5\nbob;2\n".encode("iso-8859-1"))
    utf8 = write("utf8.csv", "name,when,n\nzoë,2024-01-01,\nbob,2024-01-02,2\n")
    got = {os.path.basename(r.file): r.encoding for r in detect_encodings(spark, str(path)).collect()}
    assert got == {"latin.csv": "iso-8859-1", "utf8.csv": "utf-8"}
    df = read_delimited(spark, latin)
    assert df.columns == ["näme", "wert"] and [r[0] for r in df.collect()] == ["zoë", "bob"]
    df = read_table(spark, utf8)
    assert dict(df.dtypes) == {"name": "string", "when": "date", "n": "int"}
    assert [r.n for r in df.collect()] == [None, 2]
    with pytest.raises(ValueError):
        read_delimited(spark, str(path))


def test_types_survive_storage(spark, mixed):
    path = write_table(mixed, scratch_path(spark, "t"))
    back = read_table(spark, path)
    assert back.schema == mixed.schema and sorted(back.collect()) == sorted(mixed.collect())
    with pytest.raises(Exception):
        write_table(mixed, path)


def test_dataset_profile(spark, folder):
    _, write = folder
    path = write("a.csv", "x,y\n1,a\n2,b\n")
    p = dataset_profile(read_delimited(spark, path), path).first()
    assert (p.n_rows, p.n_cols, p.file_size_bytes) == (2, 2, 12)
    assert [tuple(c) for c in p["columns"]] == [("x", "int"), ("y", "string")]


def test_fingerprints(spark, folder):
    import hashlib

    path, write = folder
    write("a.csv", "one")
    write("b.csv", "two")
    before = fingerprints(spark, str(path))
    got = {os.path.basename(r.file): r.fingerprint for r in before.collect()}
    assert got["a.csv"] == hashlib.sha256(b"one").hexdigest()[:16]
    sheet = fingerprints(spark, str(path / "a.csv"), "Sheet1").first().fingerprint
    assert sheet == hashlib.sha256(b"oneSheet1").hexdigest()[:16]
    seen = spark.createDataFrame(before.collect(), before.schema)
    write("b.csv", "changed")
    changed = changed_files(fingerprints(spark, str(path)), seen).collect()
    assert [os.path.basename(r.file) for r in changed] == ["b.csv"]


def test_long_files_are_hashed_by_ranges(spark, folder, monkeypatch):
    import hashlib

    import dqspark.sources.files as files

    path, _ = folder
    monkeypatch.setattr(files, "RANGE", 1000)
    monkeypatch.setattr(files, "BLOCK", 300)
    sizes = {"under": 999, "one range": 1000, "over": 1001, "zwölf%20 #?": 2000, "long": 4321}
    data = {name: os.urandom(n) for name, n in sizes.items()}
    for name, content in data.items():
        (path / name).write_bytes(content)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)  # no task may take more of a file than that
    try:
        for salt in ("", "Sheet1é"):
            got = {(os.path.basename(r.file), r.bytes, r.fingerprint) for r in fingerprints(spark, str(path), salt).collect()}
            assert got == {(n, len(c), hashlib.sha256(c + salt.encode()).hexdigest()[:16]) for n, c in data.items()}
        seen = fingerprints(spark, str(path))
        seen = spark.createDataFrame(seen.collect(), seen.schema)
        (path / "long").write_bytes(data["long"][:-1] + bytes([data["long"][-1] ^ 1]))
        changed = changed_files(fingerprints(spark, str(path)), seen).collect()
        assert [os.path.basename(r.file) for r in changed] == ["long"]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
