import zipfile

from quarryspark.sources import files


def test_texts_and_uploads(spark, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.txt").write_bytes(b"plain \xff text")
    (tmp_path / "up" / "c.pdf").write_bytes(b"%PDF-1.4")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>First</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "up" / "b.docx", "w") as z:
        z.writestr("word/document.xml", body)
    got = {(r.path.rsplit("/", 1)[1], r.kind, r.text, bool(r.error)) for r in files.read_uploads(spark, str(tmp_path / "up")).collect()}
    assert got == {("a.txt", "text", "plain � text", False), ("b.docx", "paragraph", "First", False), ("b.docx", "table_row", "a | b", False), ("c.pdf", None, None, True)}
    kinds = spark.read.format("binaryFile").load(str(tmp_path / "up"))
    assert {(r.path.rsplit("/", 1)[1], r.k) for r in kinds.select("path", files.sniff(kinds["content"]).alias("k")).collect()} == {("a.txt", "binary"), ("b.docx", "zip"), ("c.pdf", "pdf")}


def test_dictionaries(spark, tmp_path):
    (tmp_path / "names.txt").write_text('# list\n"Anna"; x\nBo\nBo\nx1\nC\n')
    assert sorted(r.name for r in files.read_names(spark, str(tmp_path / "names.txt")).collect()) == ["Anna", "Bo"]
    (tmp_path / "nick.csv").write_text("Robert, Bob, Rob\nAlone\n")
    assert [tuple(r) for r in files.read_nicknames(spark, str(tmp_path / "nick.csv")).collect()] == [("Robert", ["Bob", "Rob"])]


def test_sinks(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "x int, k string").write.partitionBy("k").parquet(at)
    files.replace_partitions(spark.createDataFrame([(3, "b")], "x int, k string"), at, "k")
    assert sorted((r.x, r.k) for r in spark.read.parquet(at).collect()) == [(1, "a"), (3, "b")]
    old = str(tmp_path / "old")
    spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "k int, v int, s string").write.parquet(old)
    files.upsert_table(spark.createDataFrame([(2, 2, "z"), (3, 1, "n")], "k int, v int, s string"), old, ["k"], "v", str(tmp_path / "new"))
    assert sorted((r.k, r.s) for r in spark.read.parquet(str(tmp_path / "new")).collect()) == [(1, "x"), (2, "z"), (3, "n")]


def test_archives(spark):
    rows = spark.createDataFrame([("a", 10, 5), ("b", 10_000, 1), ("c", 5, 5), ("c", 5, 5)], "path string, size long, compressed long")
    got = {r.path: r.problem for r in files.archive_problems(rows, 1, 100_000, 100).collect()}
    assert got == {"b": "ratio too high", "c": "too many entries"}


def test_whole_texts_topics_and_lines(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes("é\nline two".encode())
    (tmp_path / "t" / "b.txt").write_bytes(b"bad \xff byte")
    assert {r.path.rsplit("/", 1)[1]: r.text for r in files.read_texts(spark, str(tmp_path / "t")).collect()} == {"a.txt": "é\nline two", "b.txt": "bad � byte"}
    (tmp_path / "topics.json").write_text('{"topic": "a", "weight": 1.5, "markers": ["x", "y"]}\n{"topic": "b"}\n')
    assert sorted(map(tuple, files.read_topics(spark, str(tmp_path / "topics.json")).collect())) == [("a", 1.5, ["x", "y"]), ("b", None, None)]
    files.json_lines(spark.range(5), str(tmp_path / "out"), 3)
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    pattern = files.name_pattern(["Ann", "B.C"])
    frame = spark.createDataFrame([("see ann.",), ("Anna",), ("b.c here",), ("bxc",)], "t string")
    assert [r.t for r in frame.where(frame.t.rlike(pattern)).collect()] == ["see ann.", "b.c here"]


def test_objects_by_key(spark, tmp_path):
    from quarryspark.sources.objects import get_objects, put_objects, safe_segment, stat_objects, training_key

    at = str(tmp_path / "objects")
    rows = lambda *r: spark.createDataFrame(list(r), "key string, content_type string, content binary")
    put_objects(rows(("a", "text/plain", b"old"), ("b", "x", b""), (None, "x", b"lost")), at, 1)
    put_objects(rows(("a", "text/plain", b"newer")), at, 2)
    assert {tuple(r) for r in stat_objects(spark, at).collect()} == {("a", "text/plain", 5, 2), ("b", "x", 0, 1)}
    refs = spark.createDataFrame([("a",), ("a",), ("none",), ("b",)], "key string")
    assert {r["key"]: r["content"] for r in get_objects(spark, at, refs).collect()} == {"a": b"newer", "b": b"", "none": None}
    parts = spark.createDataFrame([("a/b\\c",), (" x ",), ("..",), ("",), (None,)], "v string")
    assert [r[0] for r in parts.select(safe_segment(parts.v)).collect()] == ["a_b_c", "x", None, None, None]
    from pyspark.sql import functions as F

    one = spark.range(1)
    key = lambda tenant, batch: one.select(training_key(F.lit(tenant), F.lit("k"), F.lit(batch), F.lit(3))).first()[0]
    assert key(None, "b") == "tenants/default/kb/k/training/b/3/input.txt"
    assert key("t", " ") is None


def test_tables_of_tenants(spark, tmp_path):
    from quarryspark.sources.objects import scan_tenants

    for tenant, n in (("acme", 2), ("beta", 3)):
        spark.range(n).write.parquet(str(tmp_path / tenant / "items"))
    (tmp_path / "empty").mkdir()
    counts = lambda rows: {r["tenant"]: r["count"] for r in rows.groupBy("tenant").count().collect()}
    assert counts(scan_tenants(spark, str(tmp_path), "items", "id long")) == {"acme": 2, "beta": 3}
    assert counts(scan_tenants(spark, str(tmp_path), "items", "id long", ["beta"])) == {"beta": 3}


def test_claims_and_conditions(spark):
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from quarryspark.operators.filters import claim, counted, lifecycle, severity

    now = datetime(2024, 1, 1, 12)
    ago = lambda s: now - timedelta(seconds=s)
    rows = [(1, "pending", ago(1), None, None), (2, "retry", ago(-5), None, None), (3, "processing", None, ago(1), ago(9)), (4, "processing", None, None, ago(301)), (5, "processing", None, ago(-9), ago(299)), (6, "done", ago(9), None, None), (7, "processing", None, None, None), (8, "pending", None, None, None)]
    queue = spark.createDataFrame(rows, "id int, status string, next_retry_at timestamp_ntz, lease_until timestamp_ntz, locked_at timestamp_ntz")
    got = claim(queue, "id", F.lit(now).cast("timestamp_ntz"), 100, " w ").collect()
    assert [r["id"] for r in got] == [1, 3, 4]
    assert {(r["status"], r["locked_at"], r["lease_until"], r["lock_owner"]) for r in got} == {("processing", now, now + timedelta(seconds=300), "w")}
    assert [r["id"] for r in claim(queue, "id", F.lit(now).cast("timestamp_ntz"), 2, None).collect()] == [1, 3]
    states = spark.createDataFrame([(True, "deactivation_requested"), (False, "DEACTIVATION_requested"), (False, None), (None, "x")], "a boolean, s string")
    assert [r[0] for r in states.select(lifecycle(states.a, states.s)).collect()] == ["active", "temporary_deleted", "inactive", "inactive"]
    acts = spark.createDataFrame([("login_failed", None), ("view", "rate_limited"), ("view", "ok"), (None, None)], "a string, o string")
    assert [r[0] for r in acts.select(severity(acts.a, acts.o)).collect()] == ["high", "high", "medium", "medium"]
    kinds = spark.createDataFrame([("failed",), ("done",), (None,)], "s string")
    assert [r[0] for r in kinds.select(counted(kinds.s)).collect()] == [False, True, None]
