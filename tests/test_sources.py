"""Scans over many files and splits: places of records, CSV with line breaks, JSON documents, records of any shape."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.integrity import keep_first
from tessera.sources.places import ROW, with_place
from tessera.sources.reader import read_csv, read_json, read_json_lines, read_parquet
from tessera.sources.records import flatten_records
from tessera.sources.sinks import export_csv, write_json_array
from tessera.sources.split_csv import csv_records
from tessera.sources.split_json import json_records


@pytest.fixture
def cut(spark):
    """Sets how many bytes a split has."""

    def set_(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield set_
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def by_place(df):
    return sorted(df.collect(), key=lambda r: r[ROW])


# --- places --------------------------------------------------------------------------

SIZES = (1, 70, 0, 400, 3, 120)


@pytest.mark.parametrize("size", ["128m", "1500b"])
def test_places_follow_files_and_lines(spark, tmp_path, cut, size):
    """The largest file is in the middle, so tasks don't meet the files in their order."""
    n = 0
    for f, rows in enumerate(SIZES):
        with open(tmp_path / f"part{f}.csv", "w") as c, open(tmp_path / f"part{f}.jsonl", "w") as j:
            c.write("n,word\n")
            for k in range(n, n + rows):
                c.write(f"{k},w{k}\n")
                j.write(json.dumps({"n": k, "word": f"w{k}"}) + "\n")
        if rows:
            spark.range(n, n + rows).selectExpr("id as n").coalesce(1).write.parquet(str(tmp_path / f"q{f}"))
        n += rows
    cut(size)
    for multiline in (True, False):
        got = by_place(read_csv(spark, f"{tmp_path}/*.csv", multiline))
        assert [(r[ROW], r.n) for r in got] == [(k, str(k)) for k in range(n)]
    assert [(r[ROW], r.n) for r in by_place(read_json_lines(spark, f"{tmp_path}/*.jsonl"))] == [(k, k) for k in range(n)]
    assert [(r[ROW], r.n) for r in by_place(read_parquet(spark, f"{tmp_path}/q*"))] == [(k, k) for k in range(n)]


def test_places_of_row_groups(spark, tmp_path, cut):
    """A file of many row groups is read by several tasks."""
    spark.range(50_000).selectExpr("id", "uuid() as u").coalesce(1).write.option("parquet.block.size", 100_000).parquet(str(tmp_path / "t"))
    cut("200k")
    scan = spark.read.parquet(str(tmp_path / "t"))
    assert scan.rdd.getNumPartitions() > 4
    assert with_place(scan).filter(F.col("id") != F.col(ROW)).count() == 0


def test_a_filter_does_not_move_places(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(str(tmp_path / "t"))
    placed = read_parquet(spark, str(tmp_path / "t"))
    whole = {r.id: r[ROW] for r in placed.collect()}
    assert {r.id: r[ROW] for r in placed.filter("id % 10 = 3").collect()} == {k: v for k, v in whole.items() if k % 10 == 3}
    assert sorted(whole.values()) == list(range(1000))


# --- CSV -----------------------------------------------------------------------------


def odd_cells(rng, k):
    return [str(k), *("".join(rng.choices(["a", '"', "\n", ",", "\r\n", "é", " ", "x"], k=rng.randrange(12))) for _ in range(3))]


@pytest.mark.parametrize("size", ["128m", "4k", "512b"])
def test_csv_with_line_breaks_is_cut_anywhere(spark, tmp_path, cut, size):
    rng, want = random.Random(1), []
    for f, n in enumerate((0, 1, 3, 300, 50)):
        rows = [odd_cells(rng, k) for k in range(n)]
        if f == 3:
            rows[200][1] = "\n".join(["a long, cell"] * 400)
        with open(tmp_path / f"f{f}.csv", "w", newline="") as h:
            w = csv.writer(h, lineterminator="\r\n" if f % 2 else "\n")
            w.writerow(["id", "p", "q", 'na"me'])
            w.writerows(rows)
            h.write("\n\n" if f == 1 else "")
        want += rows
    cut(size)
    got = by_place(read_csv(spark, str(tmp_path)))
    assert [r[ROW] for r in got] == list(range(len(want)))
    assert [[c or "" for c in tuple(r)[:4]] for r in got] == want
    assert list(got[0].asDict()) == ["id", "p", "q", 'na"me', ROW]


def test_split_csv_equals_one_task(spark, tmp_path, cut):
    """Row for row what Spark's reader of whole files gives, nulls and empty cells included."""
    rng = random.Random(5)
    with open(tmp_path / "x.csv", "w", newline="") as h:
        h.write("a,b,c\n")
        for _ in range(500):
            h.write(",".join(rng.choice(["", '""', '"q""q"', '"one\ntwo"', " x ", "7", '"\n"']) for _ in range(rng.choice([2, 3, 3, 3, 4]))) + "\n")
    one = spark.read.options(header=True, multiLine=True, escape='"', emptyValue="").csv(str(tmp_path)).collect()
    cut("700b")
    got = by_place(read_csv(spark, str(tmp_path)))
    assert [tuple(r)[:3] for r in got] == [tuple(r) for r in one]
    assert csv_records(spark, str(tmp_path)).rdd.getNumPartitions() > 5


@pytest.fixture
def batches(spark):
    """Sets how many rows an Arrow batch has."""
    yield lambda n: spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("rows", [1, 2, 3, 7])
def test_csv_records_may_run_through_batches(spark, tmp_path, batches, rows):
    """One split, and records, the header and the last one among them, that an Arrow batch's edge runs through."""
    want = [f'{k},"{"\n" * (k % 4)}{k}"' for k in range(40)] + ['40,"\n\n\n\n\n\n\n\n"']
    (tmp_path / "x.csv").write_text('n,"a\nb\nc"\n' + "\n".join(want))
    batches(rows)
    found = csv_records(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 1
    assert [(r.value, r[ROW]) for r in by_place(found)] == [(w, k) for k, w in enumerate(want)]


def test_first_row_of_a_key_runs_through_batches(spark, tmp_path, batches):
    """The first row of every key is one that a batch's edge cuts."""
    (tmp_path / "x.csv").write_text("key,note\n" + "".join(f'{k % 5},"{k}\n"\n' for k in range(20)))
    batches(2)
    got = keep_first(read_csv(spark, str(tmp_path)), ["key"], [ROW])
    assert sorted((r.key, r.note, r[ROW]) for r in got.collect()) == [(str(k), f"{k}\n", k) for k in range(5)]


@pytest.fixture
def cores(spark):
    """Sets how many cores Spark sees when it cuts files, as executors that come or go do."""

    def set_(n):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", n)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    pinned = spark.conf.get("spark.sql.files.minPartitionNum", None)
    spark.conf.unset("spark.sql.files.minPartitionNum")
    yield set_
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    spark.conf.unset("spark.sql.files.minPartitionNum")
    if pinned:
        spark.conf.set("spark.sql.files.minPartitionNum", pinned)


@pytest.mark.parametrize(("before", "after"), [(4, 12), (12, 4), (6, 5)])
def test_first_rows_if_executors_come_or_go(spark, tmp_path, cores, before, after):
    """Rows have their places, and keys their first rows, if the number of cores changes between the passes of a scan."""
    for f in range(3):
        rows = range(f * 300, f * 300 + 300)
        (tmp_path / f"f{f}.csv").write_text("k,g,note\n" + "".join(f'{k},{k % 7},"{k}\n""x"\n' for k in rows))
        (tmp_path / f"f{f}.jsonl").write_text("".join(f'{{"k": {k}, "g": {k % 7}}}\n' for k in rows))
    for read, files in ((read_csv, "*.csv"), (read_json_lines, "*.jsonl")):
        spark.conf.unset("spark.sql.files.minPartitionNum")
        cores(before)
        found = read(spark, f"{tmp_path}/{files}")
        first = keep_first(found, ["g"], [ROW])
        cores(after)
        assert [(r[ROW], int(r.k)) for r in by_place(found)] == [(k, k) for k in range(900)]
        assert sorted(int(r.k) for r in first.collect()) == list(range(7))


def test_csv_of_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert read_csv(spark, str(tmp_path)).count() == 0
    (tmp_path / "b.csv").write_text("x,y\n")
    assert read_csv(spark, str(tmp_path)).columns == ["x", "y", ROW] and read_csv(spark, str(tmp_path)).count() == 0
    (tmp_path / "c.csv").write_text('x,y\n1,"never closed\n2,b\n')
    assert csv_records(spark, str(tmp_path)).count() == 1


# --- JSON documents ------------------------------------------------------------------


def value(rng, depth=0):
    if depth < 3 and rng.random() < 0.25:
        return {rng.choice('ab}{"\\é'): value(rng, depth + 1) for _ in range(rng.randrange(3))}
    if depth < 3 and rng.random() < 0.25:
        return [value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return rng.choice([1, 2.5, None, True, "", "x}", '{"', "\\", '\\"', "]", "[é", "\\u", "}" * 40])


def write_documents(tmp_path, make, seed):
    rng, want = random.Random(seed), []
    for f in range(3):
        rows = [{"id": k, "v": value(rng), "w": value(rng)} for k in range(rng.randrange(20, 40))]
        want += rows
        text = json.dumps(make(rows), indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)
        (tmp_path / f"f{f}.json").write_text(text + rng.choice(["", "\n"]))
    return want


@pytest.mark.parametrize("size", ["128m", "900b"])
@pytest.mark.parametrize(("make", "key"), [(lambda r: r, None), (lambda r: {"meta": {"x": {"y": 1}, "z": [{"no": 1}]}, "rows": r, "more": [{"q": 1}]}, "rows"), (lambda r: {"n": 3, "z": r, "a": [{"q": 1}]}, None)])
def test_json_documents_are_cut_anywhere(spark, tmp_path, cut, size, make, key):
    want = write_documents(tmp_path, make, 2)
    cut(size)
    got = by_place(json_records(spark, str(tmp_path), key))
    assert [json.loads(r.value) for r in got] == want
    assert [r[ROW] for r in got] == list(range(len(want)))


def test_one_element_over_many_splits(spark, tmp_path, cut):
    rows = [{"a": 1}, {"b": "}{" * 1500}, {"c": [1] * 1500}, {"d": "é"}]
    (tmp_path / "x.json").write_text(json.dumps(rows))
    cut("600b")
    assert [json.loads(r.value) for r in by_place(json_records(spark, str(tmp_path)))] == rows


@pytest.mark.parametrize(("text", "key", "want"), [
    ('{"a": []}', None, []), ('{"a": 5}', None, []), ("[]", None, []), ('{"a": [1, "x", [{"x": 1}], {"y": 2}]}', None, [{"y": 2}]), ('{"a": [{"x": 1}], "b": [{"x": 2}]}', "b", [{"x": 2}]),
    ('{"a": [{"x": 1}]}', "b", []), ('{"a": {"x": [{"z": 1}]}}', "a", []), ('{"z": [{"x": 1}], "a": [{"x": 2}]}', None, [{"x": 1}]), ('{"k\\"ey": [{"x": 1}]}', 'k"ey', [{"x": 1}]),
])
def test_lists_of_documents(spark, tmp_path, text, key, want):
    (tmp_path / "x.json").write_text(text)
    assert [json.loads(r.value) for r in json_records(spark, str(tmp_path), key).collect()] == want


@pytest.mark.parametrize("text", ['{"a": [1', '"x', "5", '[{"a": 1}]]', '{"a": "'])
def test_broken_documents_are_refused(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(ValueError):
        json_records(spark, str(tmp_path))
    (tmp_path / "x.json").write_text("[]")
    with pytest.raises(ValueError):
        json_records(spark, str(tmp_path), "rows")


# --- records of any shape --------------------------------------------------------------


def plain_flat(record):
    out = {}
    for key, v in record.items():
        if isinstance(v, dict) and not any(isinstance(x, dict | list) for x in v.values()):
            out |= {f"{key}_{k}": x for k, x in v.items()}
        else:
            out[key] = json.dumps(v, separators=(",", ":"), sort_keys=True) if isinstance(v, dict | list) else v
    return out


def test_each_record_has_its_own_shape(spark):
    """A null beside objects has a column of its own, as have plain values and nested ones."""
    records = [
        {"id": 1, "response": {"by": "x", "n": 2}, "tags": ["a"], "same": 1, "num": 1},
        {"id": 2, "response": None, "tags": [], "same": 2.5, "num": 2},
        {"id": 3, "response": "none", "tags": {"k": [1]}, "odd'] key": True, "num": None},
        {"id": 4, "response": {"by": {"deep": 1}}, "tags": None, "late": {"": False}, "response_n": 7},
        {"id": 5, "response": {}, "num": 3},
    ]
    texts = spark.createDataFrame([(json.dumps(r), k) for k, r in enumerate(records)], f"value string, {ROW} long").repartition(3)
    got = flatten_records(texts)
    want = [plain_flat(r) for r in records]
    assert got.columns == ["id", "response_by", "response_n", "tags", "same", "num", "response", "odd'] key", "late_", ROW]
    kinds = dict(got.dtypes)
    assert (kinds["id"], kinds["same"], kinds["num"], kinds["response"], kinds["odd'] key"], kinds["late_"], kinds["response_n"]) == ("bigint", "double", "bigint", "string", "boolean", "boolean", "string")
    for row, record in zip(by_place(got), want, strict=True):
        row = row.asDict()
        assert {k: v for k, v in row.items() if v is not None and k != ROW} == {k: str(v) if kinds[k] == "string" else v for k, v in record.items() if v is not None}


def test_records_of_no_rows_and_broken_ones(spark):
    empty = spark.createDataFrame([], f"value string, {ROW} long")
    assert flatten_records(empty).columns == [ROW] and flatten_records(empty).count() == 0
    with pytest.raises(Exception, match="MALFORMED"):
        flatten_records(spark.createDataFrame([('{"a": 1', 0)], f"value string, {ROW} long")).collect()


def test_read_json_gives_flat_rows(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"z": [{"a": 1, "s": {"t": "u"}}, {"a": 2, "s": None}], "b": [{"a": 9}]}))
    got = by_place(read_json(spark, str(tmp_path / "x.json")))
    assert [r.asDict() for r in got] == [{"a": 1, "s_t": "u", "s": None, ROW: 0}, {"a": 2, "s_t": None, "s": None, ROW: 1}]


def test_json_array_is_sorted_by_ranges(spark, tmp_path):
    """Many ranges make one file, whose rows are in order, and no range is sorted with all others."""
    spark.range(1000).selectExpr("(id * 37) % 500 as row_index", "id as n", "if(id % 3 = 0, null, 'é\n,') as s").repartition(5).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tasks = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("array", "")
    try:
        write_json_array(spark.read.parquet(str(tmp_path / "t")), str(tmp_path / "x.json"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tasks.getStageInfo(s) for job in tasks.getJobIdsForGroup("array") for s in tasks.getJobInfo(job).stageIds]
    assert sum(s is not None and s.numTasks > 1 for s in stages) >= 3
    want = sorted(({"row_index": n * 37 % 500, "n": n, "s": None if n % 3 == 0 else "é\n,"} for n in range(1000)), key=lambda r: (r["row_index"], json.dumps(r)))
    got = json.loads((tmp_path / "x.json").read_text())
    assert [r["row_index"] for r in got] == [r["row_index"] for r in want]
    assert sorted(r["n"] for r in got) == list(range(1000)) and all(r in want for r in got)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t", "x.json"]
    write_json_array(spark.read.parquet(str(tmp_path / "t")).filter("n < 0"), str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == []


def test_places_shuffle_no_rows(spark, tmp_path):
    """Whatever the session says about Arrow, the table of splits is known to be small, and rows too many to be sent stay where they are."""
    spark.range(5000).repartition(5).write.parquet(str(tmp_path / "t"))
    names = ("spark.sql.execution.arrow.pyspark.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n) for n in names]
    for n, value in zip(names, ("false", "4000"), strict=True):
        spark.conf.set(n, value)
    try:
        got = read_parquet(spark, str(tmp_path / "t"))
        assert sorted(r[ROW] for r in got.collect()) == list(range(5000))
        assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, value in zip(names, before, strict=True):
            spark.conf.set(n, value)


def test_compressed_csv_comes_back(spark, tmp_path):
    """Records with quotes and line breaks over several compressed files, each with a header."""
    rows = [(str(k), f'"{k}"\n,{"x" * (k % 5)}') for k in range(30)]
    export_csv(spark.createDataFrame(rows, "k string, v string").repartitionByRange(4, F.col("k").cast("int")).sortWithinPartitions(F.col("k").cast("int")), str(tmp_path / "c"), "gzip")
    assert list((tmp_path / "c").glob("*.csv.gz"))
    assert [(r.k, r.v, r[ROW]) for r in by_place(read_csv(spark, str(tmp_path / "c")))] == [(k, v, n) for n, (k, v) in enumerate(rows)]
