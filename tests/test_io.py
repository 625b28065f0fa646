import csv
import io
import json
import random

import pytest

from gaugeworks.operators import accuracy, passk, report
from gaugeworks.sources import documents, sinks, tables
from gaugeworks.streaming import live


def _write(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f)
        writer.writerow(header)
        writer.writerows(rows)


def test_unique_names():
    assert tables.unique_names(["x", "x", "x"]) == ["x", "x.1", "x.2"]
    assert tables.unique_names(["x", "x", "x.1"]) == ["x", "x.1", "x.1.1"]
    assert tables.unique_names(["a", "b"]) == ["a", "b"]


def test_read_tables(spark, tmp_path):
    header = ["Prompt", "Reference output", "Difficulty", "Resource"]
    rows = [[f'p "{i}"', f"line\n\n  two {i}", f"{1 + i % 6}.0", "a, b"] for i in range(50)]
    rows[3][0] = ""
    _write(tmp_path / "one dir" / "a.csv", header, rows)
    _write(tmp_path / "deep" / "er" / "b.csv", header, rows[:5])
    _write(tmp_path / "old" / "c.csv", ["Prompt", "Desired output", "Complexity", "x", "x"], [["q", "r", "2", "1", "2"]])
    (tmp_path / "old" / "note.txt").write_text("not a table")
    assert tables.find_tables(spark, str(tmp_path)).count() == 3
    read = tables.read_tables(spark, str(tmp_path))
    assert len(read) == 2
    tasks = read[0 if "Reference output" in read[0].columns else 1]
    typed = tables.as_tasks(tasks)
    first = [r for r in typed.collect() if r["task_file"].endswith("a.csv")]
    assert [r["row_idx"] for r in sorted(first, key=lambda r: r["row_idx"])] == list(range(50))
    by_row = {r["row_idx"]: r for r in first}
    assert by_row[7]["prompt"] == 'p "7"' and by_row[7]["reference"] == "line\n\n  two 7"
    assert by_row[3]["prompt"] is None and by_row[7]["difficulty"] == 2 and by_row[7]["resources"] == ["a", "b"]
    old = read[1 if tasks is read[0] else 0]
    assert old.columns[-2:] == ["x", "x.1"]
    assert tuple(tables.as_tasks(old).first())[2:6] == ("q", "r", None, 2)


def test_csv_round_trip_keeps_text(spark, tmp_path):
    rows = [(1, ' lead "q"\nnext, '), (2, "tab\tback\\slash"), (3, "é")]
    sinks.write_csv(spark.createDataFrame(rows, "k int, t string"), str(tmp_path / "out"))
    [table] = tables.read_tables(spark, str(tmp_path / "out"))
    assert sorted((int(r["k"]), r["t"]) for r in table.collect()) == rows


def test_write_files(spark, tmp_path):
    rows = [(n % 9, f'{{"a":"é\\\\n{n}"}}') for n in range(60)] + [(None, '{"a":"none"}'), (7, '{"a":"\\\\"}')]
    table = spark.createDataFrame(rows, "plan int, v string").repartition(4)
    sinks.write_files(table, f"file://{tmp_path}/a b/out", "plan", "v")
    files = [f for f in (tmp_path / "a b" / "out").rglob("*") if f.is_file()]
    keys = [f.name.split(".")[0].removeprefix("plan=").replace("__HIVE_DEFAULT_PARTITION__", "") for f in files]
    found = [(int(k) if k else None, f.read_bytes().decode()) for k, f in zip(keys, files)]
    assert sorted(found, key=str) == sorted([(k, v + "\n") for k, v in rows], key=str)
    # no file has a folder or a checksum of its own, each of which costs Hadoop a process
    assert len({f.parent for f in files}) <= 4
    read = documents.read_plans(spark, f"file://{tmp_path}/a b/out", glob="*.txt").selectExpr("doc:a::string AS a").collect()
    assert sorted(r["a"] for r in read) == sorted(json.loads(v)["a"] for _, v in rows)
    with pytest.raises(FileExistsError):
        sinks.write_files(table, f"file://{tmp_path}/a b/out", "plan", "v")


def test_write_files_of_odd_keys(spark, tmp_path):
    sinks.write_files(spark.createDataFrame([("../x/y", None)], "k string, v string"), str(tmp_path / "out"), "k", "v")
    [file] = [f for f in tmp_path.rglob("*") if f.is_file()]
    assert file.name == "k=..%2Fx%2Fy.0.txt" and file.read_text() == "\n"


def test_mounted_folders(spark):
    assert sinks.mounted(spark, "file:///a/b c").lstrip("/") == "a/b c" and sinks.mounted(spark, "/a#b") == "/a#b"
    assert sinks.mounted(spark, "hdfs://host/a") is None and sinks.mounted(spark, "file://host/a") is None


def test_nested_report(spark, tmp_path):
    rows = [("m", "s", "acc", "", 0.5), ("m", "s", "level", "1", 1.0), ("m", "s", "level", "2", 0.0), ("n", "s", "acc", "", None)]
    table = spark.createDataFrame(rows, "model string, strategy string, metric string, key string, value double")
    sinks.write_report(table, str(tmp_path / "r"))
    text = spark.read.text(str(tmp_path / "r")).first()[0]
    assert json.loads(text) == {"m": {"s": {"acc": 0.5, "level": {"1": 1.0, "2": 0.0}}}, "n": {"s": {"acc": None}}}
    counts = spark.createDataFrame([("b", 2), ("a", 1)], "k string, n long")
    sinks.write_histogram(counts, "k", "n", str(tmp_path / "h"))
    assert json.loads(spark.read.text(str(tmp_path / "h")).first()[0]) == {"a": 1, "b": 2}


def test_metrics_by_name_and_enrichment(spark):
    with pytest.raises(ValueError, match="unknown metric"):
        report.default_metrics().run("nope", spark.range(1))
    own = report.default_metrics()
    own.add("rows", lambda df: df.groupBy().count())
    assert own.run("rows", spark.range(3)).first()[0] == 3
    schema = "model string, strategy string, metric string, key string, value double"
    base = spark.createDataFrame([("m", "s", "x", "", 1.0), ("n", "s", "x", "", 2.0)], schema)
    other = spark.createDataFrame([("m", "s", "accuracy", "", 0.5), ("m", "s", "accuracy", "1", 0.1)], schema)
    got = {(r["model"], r["metric"]): r["value"] for r in report.enrich(base, other).collect()}
    assert got == {("m", "x"): 1.0, ("n", "x"): 2.0, ("m", "accuracy"): 0.5, ("n", "accuracy"): None}


def test_documents_and_plans(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("one\ntwo")
    assert tuple(documents.read_documents(spark, str(tmp_path / "d")).first()) == ("a.md", "one\ntwo")
    (tmp_path / "p" / "x").mkdir(parents=True)
    (tmp_path / "p" / "x" / "plan.json").write_text(json.dumps({"a": {"b": [1]}}, indent=2))
    row = documents.read_plans(spark, str(tmp_path / "p")).selectExpr("plan_id", "doc:a.b[0]::int AS b").first()
    assert row["plan_id"].endswith("x/plan.json") and row["b"] == 1


SCHEMA = "model string, strategy string, row_idx long, sample_idx int, prompt string, plannable boolean, verdict string, ts timestamp"


def _arrivals(spark, path, start, stop):
    rows = spark.range(start, stop).selectExpr(
        "concat('m', id % 3) AS model", "'s' AS strategy", "id AS row_idx", "0 AS sample_idx",
        "if(id % 7 = 0, NULL, 'p') AS prompt", "id % 2 = 0 AS plannable", "if(id % 4 = 0, 'Success', 'Failure') AS verdict",
        "timestamp_seconds(id) AS ts",
    )
    rows.write.mode("append").parquet(path)


def test_live_report_equals_batch(spark, tmp_path):
    source, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for start in (0, 100):
        _arrivals(spark, source, start, start + 100)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(source)
        live.start_report(stream, path, state).awaitTermination()
    want = accuracy.accuracy(spark.read.parquet(source))
    got = live.read_report(spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ingestion_resumes_without_repeats(spark, tmp_path):
    source, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    done = spark.createDataFrame([("m0", 0, 0), ("m1", 1, 0)], "model string, row_idx long, sample_idx int")
    for start in (0, 40, 60):
        _arrivals(spark, source, start, start + 50)  # overlaps what came before
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        live.start_ingestion(stream, path, state, ["model", "row_idx", "sample_idx"], done).awaitTermination()
    rows = sorted(r["row_idx"] for r in spark.read.parquet(path).collect())
    assert rows == list(range(2, 110))


@pytest.mark.parametrize(("batches", "remember"), [(1, "1 hour"), (4, None), (4, "1 hour"), (40, "1 hour")])
def test_ingestion_keeps_every_sample_in_any_order(spark, tmp_path, batches, remember):
    source, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rng = random.Random(batches)
    keys = [rng.randrange(400) for _ in range(1000)]  # event times of any order, most keys repeated
    size = -(-len(keys) // batches)
    for i in range(batches):
        part = spark.createDataFrame([(k,) for k in keys[i * size : (i + 1) * size]], "row_idx long")
        part.selectExpr("row_idx", "timestamp_seconds(row_idx * 86400 * 30) AS ts").coalesce(1).write.mode("append").parquet(source)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        stream = spark.readStream.schema("row_idx long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        query = live.start_ingestion(stream, path, state, ["row_idx"], remember=remember)
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == batches
    rows = spark.read.parquet(path)
    assert rows.columns == ["row_idx", "ts"]
    assert sorted(r["row_idx"] for r in rows.collect()) == sorted(set(keys))


def test_live_task_report_equals_batch_after_every_batch(spark, tmp_path):
    source, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    tasks = spark.range(12).selectExpr("'f' AS task_file", "id AS row_idx", "cast(1 + id % 4 AS int) AS difficulty")
    rng = random.Random(3)
    rows = [
        (f"m{t % 2}", "s", "f", t, i, "p" if t % 5 else None, rng.random() < 0.7, rng.choice(["Success", "Failure"]))
        for t in range(12)
        for i in range(4)
    ]
    rng.shuffle(rows)
    schema = "model string, strategy string, task_file string, row_idx long, sample_idx int, prompt string, plannable boolean, verdict string"
    known = {}
    for part in (rows[:15], rows[15:40], rows[40:] + rows[:3], [(*r[:6], True, "Success") for r in rows[:9]]):
        known |= {r[:5]: r for r in part}
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        live.start_task_report(stream, tasks, path, state, n=3).awaitTermination()
        arrived = spark.createDataFrame(list(known.values()), schema)
        want = passk.pass_at_k_report(arrived, 3, strict=False).selectExpr("model", "strategy", "metric", "cast(k AS string) AS key", "value")
        want = want.unionByName(accuracy.accuracy_by_level(arrived, tasks))
        got = live.read_task_report(spark, path, n=3)
        values = [sorted((*r[:4], round(r[4], 9)) for r in df.select("model", "strategy", "metric", "key", "value").collect()) for df in (got, want)]
        assert values[0] == values[1] and values[0]


def test_tasks_share_states(spark, tmp_path):
    source, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    columns = ["'m' AS model", "'s' AS strategy", "'f' AS task_file", "if(id < 999, id, NULL) AS row_idx", "0 AS sample_idx", "'p' AS prompt"]
    rows = spark.range(1000).selectExpr(*columns, "true AS plannable", "if(id % 4 = 0, 'Success', '') AS verdict")
    rows.write.parquet(source)
    tasks = spark.range(1000).selectExpr("'f' AS task_file", "id AS row_idx", "1 AS difficulty")
    query = live.start_task_report(spark.readStream.schema(rows.schema).parquet(source), tasks, path, state, n=1)
    query.awaitTermination()
    # the stream-static join keeps nothing, so these are the states of the tasks
    assert sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"]) <= live.TASK_BUCKETS
    [got] = live.read_task_report(spark, path, n=1).where("metric = 'pass@k'").collect()
    assert got["value"] == 0.25


def test_header_cells_may_hold_line_breaks(spark, tmp_path):
    _write(tmp_path / "a.csv", ["k", "two\nlines", "last"], [["1", "2", "3"], ["4", "", "6", "more"], ["7"]])
    (tmp_path / "empty.csv").write_text("")
    [table] = tables.read_tables(spark, str(tmp_path))
    assert table.columns == ["task_file", "row_idx", "k", "two\nlines", "last"]
    rows = [tuple(r)[1:] for r in table.orderBy("row_idx").collect()]
    assert rows == [(0, "1", "2", "3"), (1, "4", None, "6"), (2, "7", None, None)]


def test_many_files_of_two_kinds(spark, tmp_path):
    for i in range(300):
        _write(tmp_path / f"f{i}.csv", ["a", "b"] if i % 3 else ["a", "c"], [[str(i), "x"]])
    counts = {tuple(t.columns[2:]): t.count() for t in tables.read_tables(spark, str(tmp_path))}
    assert counts == {("a", "b"): 200, ("a", "c"): 100}


def test_booleans_and_attribution_of_read_tables(spark, tmp_path):
    _write(tmp_path / "gpt" / "COT" / "a.csv", ["flag"], [["True"], ["false"], [""]])
    [table] = tables.read_tables(spark, str(tmp_path))
    flags = [r["flag"] for r in tables.as_booleans(table, ["flag"]).orderBy("row_idx").collect()]
    assert flags == [True, False, False]


def _random_csv(rng, n):
    parts = ["a", "é", ",", '"', "\n", "\r\n", " ", "x" * 30, "\\"]
    return [["".join(rng.choices(parts, k=rng.randint(0, 6))) for _ in range(3)] for _ in range(n)]


@pytest.mark.parametrize(("block", "ending"), [("1m", "\n"), ("150", "\r\n"), ("17", "\n")])
def test_records_are_the_same_wherever_files_are_cut(spark, tmp_path, block, ending):
    want = {}
    for i in range(4):
        rng = random.Random(f"{block}{i}")
        rows = _random_csv(rng, rng.choice([0, 3, 25 if len(block) > 2 else 6]))
        text = io.StringIO()
        writer = csv.writer(text, lineterminator=ending)
        writer.writerow(["k", "two\nlines", "l"])
        for row in rows:
            writer.writerow(row)
            if rng.random() < 0.2:
                text.write(ending)
        (tmp_path / f"f{i}.csv").write_text(text.getvalue(), newline="", encoding="utf-8-sig" if i else "utf-8")
        again = [r for r in csv.reader(io.StringIO(text.getvalue(), newline="")) if r][1:]
        assert again == rows
        want |= {(f"f{i}.csv", at): tuple(c or None for c in r) for at, r in enumerate(rows)}
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        [table] = tables.read_tables(spark, str(tmp_path))
        got = {(r[0].rsplit("/", 1)[1], r[1]): tuple(r)[2:] for r in table.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert table.columns[2:] == ["k", "two\nlines", "l"] and got == want
