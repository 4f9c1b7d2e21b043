"""Readers keep bad rows as data, and sources that can't be read raise."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from loomgraph.errors import ConfigurationError, Conflict, SourceError
from loomgraph.sources import records as R
from loomgraph.sources.store import Store


def _write(tmp_path, name, body):
    path = tmp_path / name
    path.write_bytes(body.encode())
    return str(path)


def test_csv(spark, tmp_path):
    path = _write(tmp_path, "a.csv", 'id,name,team\n1,Ann,\n2,"Bo""b, jr",Reds\n3,"two\nlines",x\n\n4\n5,a,b,c,d\n')
    rows = R.collect_rows(R.from_csv(spark, path))
    data = [(r["data"]["id"], r["data"]["name"], r["data"]["team"], r["data"][R.SURPLUS]) for r in rows]
    assert data == [("1", "Ann", "", None), ("2", 'Bo"b, jr', "Reds", None), ("3", "two\nlines", "x", None), ("4", None, None, None), ("5", "a", "b", ["c", "d"])]
    assert [[i["code"] for i in r["issues"]] for r in rows] == [[], [], [], ["short_row"], ["unnamed_columns"]]
    assert all(i["severity"] == "warning" for r in rows for i in r["issues"])
    assert [r["rec_idx"] for r in rows] == [0, 1, 2, 3, 4] and rows[1]["coord"]["fragment"] == "row=3"


def test_csv_delimiter_and_header_only(spark, tmp_path):
    assert R.collect_rows(R.from_csv(spark, _write(tmp_path, "b.csv", "a;b\n1;2\n"), delimiter=";"))[0]["data"]["b"] == "2"
    assert R.collect_rows(R.from_csv(spark, _write(tmp_path, "c.csv", "a,b\n"))) == []


def test_json_lines(spark, tmp_path):
    path = _write(tmp_path, "a.jsonl", '{"a": 1}\n\n{"a": \n5\n{"a": "x"}\n')
    rows = R.collect_rows(R.from_json(spark, path))
    assert [[i["code"] for i in r["issues"]] for r in rows] == [[], ["malformed_json"], ["not_an_object"], []]
    assert [r["coord"]["fragment"] for r in rows] == ["line=1", "line=3", "line=4", "line=5"]
    assert [r["rec_idx"] for r in rows] == [0, 1, 2, 3] and rows[1]["data"] is None


def test_json_array(spark, tmp_path):
    path = _write(tmp_path, "a.json", ' [{"a": 1}, 2, {"a": "x"}]')
    rows = R.collect_rows(R.from_json(spark, path))
    assert [[i["code"] for i in r["issues"]] for r in rows] == [[], ["not_an_object"], []]
    with pytest.raises(SourceError):
        R.from_json(spark, _write(tmp_path, "b.json", '[{"a": 1}'))
    with pytest.raises(SourceError):
        R.from_json(spark, str(tmp_path / "none.json"))


def test_csv_json_and_memory_agree(spark, tmp_path):
    from loomgraph.operators.normalize import Field, normalize

    rows = [{"id": "p1", "height": "170"}, {"id": "p2", "height": "175"}]
    fields = [Field("id", required=True), Field("height", "int")]
    sources = [
        R.from_rows(spark, rows, "id string, height string"),
        R.from_csv(spark, _write(tmp_path, "p.csv", "id,height\np1,170\np2,175\n")),
        R.from_json(spark, _write(tmp_path, "p.jsonl", '{"id":"p1","height":170}\n{"id":"p2","height":"175"}\n')),
        R.from_json(spark, _write(tmp_path, "p.json", json.dumps(rows))),
    ]
    got = [[tuple(r["values"]) for r in normalize(s.frame, fields).orderBy("rec_idx").collect()] for s in sources]
    assert all(g == [("p1", 170), ("p2", 175)] for g in got)


def test_sequential_is_gapless(spark):
    frame = R.sequential(spark.range(1000, numPartitions=7).where("id % 3 <> 0"))
    got = frame.orderBy("id").collect()
    assert [r["rec_idx"] for r in got] == list(range(len(got)))


def test_rows_of_a_sorted_table_are_numbered_once(spark):
    """With the session's own partitions, at a size where two jobs over one sort differ."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        line = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
        frame = R.TableSnapshot(line, ["l_orderkey", "l_linenumber"], "lineitem", version="v").open().frame
        found = frame.agg(F.count("*"), F.count_distinct("rec_idx"), F.min("rec_idx"), F.max("rec_idx")).first()
        assert tuple(found) == (600000, 600000, 0, 599999)
        sums = frame.select("rec_idx", "data.l_orderkey").sample(0.01, 3).orderBy("rec_idx").collect()
        assert [r[1] for r in sums] == sorted(r[1] for r in sums)
        assert R.sequential(line.orderBy("l_partkey")).agg(F.count_distinct("rec_idx")).first()[0] == 600000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_literals_and_identifiers():
    assert [R.sql_literal(x) for x in (1, -2.5, True, "a'b; drop")] == ["1", "-2.5", "TRUE", "'a''b; drop'"] and R.quote_identifier('a"b') == '"a""b"'
    for bad in (None, float("nan"), b"x", "a\0"):
        with pytest.raises(ConfigurationError):
            R.sql_literal(bad)


def test_snapshot(spark, tmp_path):
    table = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "id long, name string")
    opened = R.TableSnapshot(table, ["id"], "db.players", folder=str(tmp_path / "pin")).open()
    rows = R.collect_rows(opened)
    assert [r["data"]["id"] for r in rows] == [1, 2, 3] and rows[0]["coord"]["fragment"] == "id=1"
    version = R.snapshot_version(table)
    assert opened.locator == f"db.players@snapshot={version}" and rows[0]["coord"]["source_version"] == version
    assert R.snapshot_version(table.orderBy(F.col("id").desc())) == version != R.snapshot_version(table.where("id > 1"))
    assert table.select(R.key_fragment(["id", "name"], None)).collect()[2][0] == "id=3&name=None"


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("create table players (id text primary key, name text, height int)")
        db.executemany("insert into players values (?, ?, ?)", [("b", "Bo", 2), ("a", "Ann", None), ("c", "Cy", 3)])
    frame = R.sqlite_table(spark, path, "players", ["id", "height"], where="id <> 'c'", keys=["id"])
    assert [tuple(r) for r in frame.collect()] == [("a", None), ("b", 2)]
    assert dict(frame.dtypes) == {"id": "string", "height": "bigint"}


def test_two_writers_and_a_reader(spark, tmp_path):
    """Both write on one version; the reader that lists in between sees whole commits only."""
    make = lambda: Store(spark, str(tmp_path / "s"), {"a": "x long"})
    one, two, reader = make(), make(), make()
    frame = lambda n: spark.createDataFrame([(n,)], "x long")
    one.commit({"a": frame(1)})
    base = two.version()
    (tmp_path / "s" / "_commits" / ".draft-other").write_text("{")  # a writer that was lost while it wrote
    one.commit({"a": frame(2)}, base=base)
    assert reader.version() == 2 and sorted(r[0] for r in reader.read("a").collect()) == [1, 2]
    with pytest.raises(Conflict):
        two.commit({"a": frame(3)}, base=base)
    assert two.commit({"a": frame(4)}) == 3 and sorted(r[0] for r in reader.read("a").collect()) == [1, 2, 4]
    assert reader.compact() == 4 and len(reader.state()["a"]) == 1 and sorted(r[0] for r in two.read("a").collect()) == [1, 2, 4]


def test_parts_are_replaced_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"a": "k int, x long"}, {"a": "k"})
    rows = lambda *r: spark.createDataFrame(r, "k int, x long")
    store.commit({"a": rows((1, 1), (2, 2), (1, 3))})
    store.commit({"a": rows((1, 4))})
    before = set(store.state()["a"])
    store.commit(replace_parts={"a": (store.read("a", parts=[1]).where("x <> 1"), [1])})
    assert sorted(tuple(r) for r in store.read("a").collect()) == [(1, 3), (1, 4), (2, 2)] and len(before & set(store.state()["a"])) == 1
    assert store.vacuum() == 0 and store.vacuum(0) == 2 and store.read("a").count() == 3


def test_store_commits_whole_and_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"a": "x long", "b": "y string"})
    assert store.version() == 0 and store.read("a").count() == 0
    one = spark.createDataFrame([(1,)], "x long")
    assert store.commit({"a": one, "b": spark.createDataFrame([("k",)], "y string")}) == 1
    store.commit({"a": spark.createDataFrame([(2,)], "x long")})
    assert sorted(r[0] for r in store.read("a").collect()) == [1, 2] and store.read("a", 1).count() == 1
    with pytest.raises(Conflict):
        store.commit({"a": one}, base=1)
    store.commit(None, {"a": one})
    other = Store(spark, str(tmp_path / "s"), {"a": "x long"})
    last = tmp_path / "s" / "_commits" / "0000000003.json"
    kept = last.read_text()
    (tmp_path / "s" / "_commits" / ".0000000003.json.crc").unlink(missing_ok=True)
    last.write_text(kept.replace('"format": 1', '"format": 9'))
    with pytest.raises(ConfigurationError):
        other.read("a")
    last.write_text(kept)
    assert [r[0] for r in store.read("a").collect()] == [1] and store.vacuum() == 0 and store.vacuum(0) == 3 and store.read("b").count() == 1
