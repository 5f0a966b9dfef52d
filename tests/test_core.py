"""The library's own operators: golden cases and a dictionary model."""

import random

import pytest
from pyspark.sql import functions as F

from kvlog.functions import geometry as g
import __spark_entry__
from kvlog.operators import caches, cachesim, merge, ranges, resolve, secondary
from kvlog.operators.schema import Log
from kvlog.plans import catalog
from kvlog.sources import layout
from kvlog.streaming import feed

LOG = Log(key=("k",), seq="s", value=("v",), op="op")
SCHEMA = "k long, s long, op string, v long"


def random_log(seed, n=300):
    r = random.Random(seed)
    return [(r.randrange(20), i, r.choice(["put", "delete", "merge", "merge"]), r.randrange(100)) for i in range(n)]


def test_fold_against_dictionary(spark):
    rows = random_log(1)
    for at in (50, 299):
        state = {}
        for k, s, op, v in rows:
            if s <= at:
                if op == "put":
                    state[k] = v
                elif op == "delete":
                    state.pop(k, None)
                else:
                    state[k] = state.get(k, 0) + v
        got = {r["k"]: r["value"] for r in merge.fold(spark.createDataFrame(rows, SCHEMA).repartition(3), LOG, "sum", at).collect()}
        assert got == state


def test_tombstone_golden(spark):
    t = spark.createDataFrame([("a", "e", 10), ("c", "g", 15)], "begin string, end string, seq long")
    assert sorted(map(tuple, ranges.fragments(t).collect())) == [("a", "c", 10), ("c", "e", 15), ("e", "g", 15)]
    log = spark.createDataFrame([("morning", 5, 1), ("morning", 2, 1), ("night", 3, 1)], "k string, s long, v long")
    gone = spark.createDataFrame([("ma", "mz", 4)], "begin string, end string, seq long")
    assert sorted((r["k"], r["s"]) for r in ranges.apply_tombstones(log, gone, Log(("k",), "s")).collect()) == [("morning", 5), ("night", 3)]


def test_agg_merge_golden(spark):
    def run(ops):
        rows = [(1, i, f, v) for i, (f, v) in enumerate(ops)]
        return merge.agg_merge(spark.createDataFrame(rows, "k long, s long, f string, v long"), LOG, "f", "v").first()

    assert run([("sum", 10), ("sum", 20), ("sum", 15)])["value"] == 45
    assert run([("", 30), ("sum", 10), ("sum", 20)])["value"] == 60
    assert run([("mul", 10), ("mul", 10), ("mul", 10), ("sum", 10)])["value"] == 1010
    assert run([("mul", 10), ("mul", 20), ("sum", 30), ("sum", 40)])["value"] == 270
    assert run([("nope", 1)])["status"] == "error"


def test_last3_golden(spark):
    rows = spark.createDataFrame([(1, 1, "a,b"), (1, 2, "c,d,e"), (1, 3, "f")], "k long, s long, v string")
    assert merge.fold(rows, Log(("k",), "s", ("v",)), "last3").first()["value"] == ["f", "c", "d"]


def test_box_rules(spark):
    rows = [(1, 0.0, 1.0, 0.0, 1.0), (2, 1.0, 2.0, 1.0, 2.0), (3, float("nan"), 1.0, 0.0, 1.0), (4, None, 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, xmin double, xmax double, ymin double, ymax double")
    box = ("xmin", "xmax", "ymin", "ymax")
    assert [r["id"] for r in df.where(g.intersects(box, (1.0, 1.0, 1.0, 1.0))).collect()] == [1, 2]
    assert df.where(g.intersects(box, None)).count() == 4
    q = spark.createDataFrame([(i, i * 0.3, i * 0.3 + 0.5, 0.2, 1.4) for i in range(8)], "qid long, x0 double, x1 double, y0 double, y1 double")
    pairs = lambda x: sorted(map(tuple, x.collect()))
    assert pairs(secondary.box_join(df.limit(2), q, box, "id")) == pairs(secondary.box_join(df.limit(2), q, box, "id", cell=0.4))


def test_modes_agree(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    log = Log(("user_id", "event_type"), "event_id", ("value",))
    found = [secondary.secondary_scan(e, log, g.in_range("value", (20, 60)), m).count() for m in ("latest", "memo", "two_pass")]
    assert found == [32, 32, 32]


def test_hilbert_is_a_walk(spark):
    cells = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    path = [(r["x"], r["y"]) for r in cells.withColumn("h", g.hilbert_udf(4)("x", "y")).orderBy("h").collect()]
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(path, path[1:]))


def test_simulators():
    blocks = list("abcabcd")
    ones = [1] * len(blocks)
    assert cachesim.misses(blocks, ones, 3, "lru") == 4
    assert cachesim.misses(blocks, ones, 2, "lru") == 7
    assert cachesim.misses(blocks, ones, 2, "opt") == 5
    assert cachesim.misses(blocks, ones, 9, "lfu") == 4


def test_registered_simulators_replay_one_cache(spark):
    d = "/root/testdata/sf0.001"
    trace = spark.read.parquet(f"{d}/events.parquet").orderBy("event_id").select(F.col("user_id").cast("string"), F.length("props"), "event_type").collect()
    blocks, sizes, labels = ([r[i] for r in trace] for i in range(3))
    for policy in set(caches.POLICIES) - {"hybrid"}:
        out = {r["capacity"]: (r["accesses"], r["misses"]) for r in __spark_entry__.queries()[f"{policy}_misses"](spark, d).collect()}
        assert out == {c: (len(trace), cachesim.misses(blocks, sizes, c, policy, labels)) for c in (128, 512, 2048)}, policy


def test_whole_tables_against_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    for name in ("kv_scan_reverse", "range_center_sort", "merge_mul_sign", "wide_default_column", "batch_write"):
        db = duckdb.connect()
        for t in ("customer", "events", "orders"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
        want = db.execute(catalog.ORACLE_SQL[name]).fetchall()
        assert sorted(map(tuple, catalog.QUERIES[name](spark, d).collect())) == sorted(want), name


def test_pushdown_and_layout(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") % 100).cast("double").alias("v"))
    layout.write_sorted(df, f"{tmp_path}/v", "v", files=4)
    plan = spark.read.parquet(f"{tmp_path}/v").where(g.in_range("v", (5, 7)))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(v,5" in plan
    assert layout.manifest(spark, f"{tmp_path}/v", ["v"]).count() == 4


@pytest.mark.parametrize("fold", ["sum", None])
def test_stream_equals_batch(spark, tmp_path, fold):
    rows = random_log(4)
    for i in range(5):  # operands are folded as they arrive in order; unfolded, late rows count as if they had been in time
        part = rows[60 * i : 60 * i + 60] if fold else rows[i::5]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    q = feed.compact_into(feed.changes(spark, f"{tmp_path}/log", SCHEMA, "s", files_per_trigger=1), LOG, f"{tmp_path}/out", f"{tmp_path}/cp", fold=fold, every=2)
    q.awaitTermination(90)
    state = feed.follower(spark, f"{tmp_path}/out")
    assert state.count() < len(rows)
    got = sorted(map(tuple, merge.fold(state, LOG, "sum").collect()))
    assert got == sorted(map(tuple, merge.fold(spark.createDataFrame(rows, SCHEMA), LOG, "sum").collect()))
