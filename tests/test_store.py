"""Writes, compaction, tombstones, copies, joins, codings, statistics, streams and the command line, against plain Python."""

import datetime
import io
import random
import struct

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kvlog import cli
from kvlog.functions import coding
from kvlog.functions import geometry as g
from kvlog.operators import asof, caches, cachesim, compact, grouping, merge, ordering, ranges, secondary, trace, writes
from kvlog.operators.schema import Log
from kvlog.plans import extensions
from kvlog.sources import archive, layout
from kvlog.streaming import feed

LOG = Log(key=("k",), seq="s", value=("v",), op="op")
SCHEMA = "k long, s long, op string, v long"


def random_log(seed, n=300, keys=20):
    r = random.Random(seed)
    return [(r.randrange(keys), i, r.choice(["put", "delete", "merge", "merge"]), r.randrange(100)) for i in range(1, n + 1)]


def read(rows, at=10**9, tombs=()):
    """What a reader at a sequence sees: key -> folded sum."""
    state = {}
    for k, s, op, v in sorted(rows, key=lambda r: r[1]):
        if s > at or any(b <= k < e and s < ts <= at for b, e, ts in tombs):
            continue
        if op == "put":
            state[k] = v
        elif op == "delete":
            state.pop(k, None)
        else:
            state[k] = state.get(k, 0) + v
    return state


def kept(spark, rows, **options):
    return [tuple(r) for r in compact.compact(spark.createDataFrame(rows, SCHEMA), LOG, **options).collect()]


def test_compaction_keeps_merge_operands(spark):
    rows = [(1, 1, "put", 10), (1, 2, "merge", 5), (1, 3, "merge", 7)]
    assert sorted(kept(spark, rows)) == rows
    assert kept(spark, rows, fold="sum") == [(1, 3, "put", 22)]


def test_compaction_at_snapshots_reads_alike(spark):
    tombs = [(3, 9, 120), (5, 6, 260), (0, 2, 40)]
    t = spark.createDataFrame(tombs, "begin long, end long, seq long")
    for seed in (1, 2):
        rows = random_log(seed)
        for fold in (None, "sum"):
            out = kept(spark, rows, tombstones=t, snapshots=(100, 200), fold=fold)
            assert len(out) < len(rows)
            for at in (100, 200, 300):
                assert read(out, at, tombs) == read(rows, at, tombs), (seed, fold, at)


def test_a_tombstone_spares_what_an_older_snapshot_sees(spark):
    t = spark.createDataFrame([(1, 2, 3)], "begin long, end long, seq long")
    assert kept(spark, [(1, 1, "put", 5)], tombstones=t, snapshots=(2,)) == [(1, 1, "put", 5)]
    assert kept(spark, [(1, 1, "put", 5)], tombstones=t) == []


def test_compaction_is_idempotent(spark):
    once = kept(spark, random_log(3), fold="sum")
    assert sorted(kept(spark, once, fold="sum")) == sorted(once)


def test_a_removed_value_hides_older_ones(spark):
    rows = [(1, 1, "put", 5), (1, 9, "put", 6)]
    out = kept(spark, rows, drop=F.col("v") == 6, snapshots=(4,))
    assert sorted(out, key=lambda r: r[1]) == [(1, 1, "put", 5), (1, 9, "delete", None)] and read(out) == {}
    assert kept(spark, rows, drop=F.col("v") == 6) == []


@pytest.mark.parametrize("kind", ["long", "string"])
def test_tombstones_on_both_paths(spark, kind):
    r = random.Random(7)
    name = (lambda i: i) if kind == "long" else (lambda i: f"k{i:04d}")
    log = [(name(r.randrange(200)), s) for s in range(400)]
    tombs = [(name(a), name(a + r.randrange(0, 60)), r.randrange(400)) for a in (r.randrange(200) for _ in range(60))] + [(name(0), name(190), 30)]
    want = sorted((k, s) for k, s in log if not any(b <= k < e and ts > s for b, e, ts in tombs))
    df, t = spark.createDataFrame(log, f"k {kind}, s long").repartition(3), spark.createDataFrame(tombs, f"begin {kind}, end {kind}, seq long")
    for few in (10**6, 0):
        assert sorted(map(tuple, ranges.apply_tombstones(df, t, Log(("k",), "s"), broadcast_up_to=few).collect())) == want
    cover = {}
    for b, e, ts in ranges.fragments(t).collect():
        for i in range(260):
            if b <= name(i) < e:
                assert name(i) not in cover
                cover[name(i)] = ts
    assert cover == {name(i): max(ts for b, e, ts in tombs if b <= name(i) < e) for i in range(260) if any(b <= name(i) < e for b, e, _ in tombs)}


def test_inverted_range_deletes_raise(spark):
    t = spark.createDataFrame([(5, 2, 9)], "begin long, end long, seq long")
    for few in (10, 0):
        with pytest.raises((PySparkException, Py4JJavaError)):
            ranges.apply_tombstones(spark.createDataFrame([(1, 1)], "k long, s long"), t, Log(("k",), "s"), broadcast_up_to=few).collect()
    with pytest.raises(writes.InvalidArgument):
        writes.WriteBatch().delete_range("b", "a")
    with pytest.raises(writes.NotSupported):
        writes.WriteBatch().merge("a", "1")
    bad = spark.createDataFrame([("delete_range", "b", "a")], "op string, key string, end string")
    with pytest.raises((PySparkException, Py4JJavaError)):
        writes.checked(bad).collect()


def test_write_batch(spark):
    b = writes.WriteBatch("append")
    b.put("a", "1").put_entity("b", {"z": "2", "": "0"})
    b.set_save_point()
    b.delete("a").single_delete("b")
    b.rollback_to_save_point()
    b.merge("a", "x").delete_range("c", "d")
    assert b.count() == 4 and not b.has("delete") and [r[0] for r in b.rows] == [0, 1, 2, 3]
    assert b.to_df(spark).where("op = 'put_entity'").first()["columns"] == {"": "0", "z": "2"}
    log = spark.createDataFrame([("q", 7, "put", "9")], "key string, seq long, op string, value string")
    out = writes.commit(log, b.to_df(spark).drop("columns"))
    assert sorted((r["seq"], r["op"]) for r in out.collect()) == [(7, "put"), (8, "put"), (9, "put_entity"), (10, "merge"), (11, "delete_range")]
    with pytest.raises(writes.InvalidArgument):
        b.rollback_to_save_point()


def test_numbers_in_order(spark):
    r = random.Random(4)
    rows = [(r.choice([None, *range(40)]), r.choice("abc"), r.randrange(9)) for _ in range(500)]
    rows = [(a, b, c, i) for i, (a, b, c) in enumerate(rows)]
    df = spark.createDataFrame(rows, "a int, b string, c int, i long").repartition(5)
    got = ordering.running_sum(ordering.numbered(df, F.desc("a"), "b", "i", alias="n"), "c", F.desc("a"), "b", "i")
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1], r[3]))
    sums, want = 0, {}
    for n, row in enumerate(order):
        sums += row[2]
        want[row[3]] = (n, sums)
    assert {r["i"]: (r["n"], r["running"]) for r in got.collect()} == want
    assert ordering.numbered(df.limit(0), "a", alias="n").count() == 0


def test_asof_join(spark):
    r = random.Random(9)
    facts = [(r.choice([1, 1, 1, 2, None]), r.randrange(300), r.randrange(10**6)) for _ in range(200)]
    facts = list({(k, t): (k, t, v) for k, t, v in facts}.values())
    asked = [(i, r.choice([1, 1, 2, 3, None]), r.randrange(-5, 310)) for i in range(150)]
    want = {}
    for i, k, t in asked:
        best = max(((ft, v) for fk, ft, v in facts if k is not None and fk == k and ft <= t), default=(None, None))
        want[i] = best[1]
    left, right = spark.createDataFrame(asked, "i long, k int, t long").repartition(4), spark.createDataFrame(facts, "k int, ft long, v long").repartition(3)
    got = asof.asof_join(left, right, "k", "t", "ft", ["v"])
    assert got.columns == ["i", "k", "t", "v"] and {r["i"]: r["v"] for r in got.collect()} == want
    assert {r["v"] for r in asof.asof_join(left, right.limit(0), "k", "t", "ft", ["v"]).collect()} == {None}


def test_box_join_paths_agree(spark):
    r = random.Random(2)
    nan = float("nan")
    span = lambda: (lambda a: (a, a + r.choice([0.0, 0.5, 3.0, 400.0])))(r.uniform(-50, 50))
    boxes = [(i, *span(), *span()) for i in range(120)] + [(900, nan, 1.0, 0.0, 1.0), (901, 0.0, nan, 0.0, 1.0), (902, None, 1.0, 0.0, 1.0)]
    queries = [(i, *span(), *span()) for i in range(40)] + [(99, nan, 5.0, 0.0, 5.0)]
    df = spark.createDataFrame(boxes, "id long, xmin double, xmax double, ymin double, ymax double")
    q = spark.createDataFrame(queries, "qid long, x0 double, x1 double, y0 double, y1 double")
    box = ("xmin", "xmax", "ymin", "ymax")
    want = sorted((a[0], b[0]) for a in queries[:-1] for b in boxes[:-3] if b[2] >= a[1] and b[1] <= a[2] and b[4] >= a[3] and b[3] <= a[4])
    for cell in (None, 2.0):
        assert sorted(map(tuple, secondary.box_join(df, q, box, "id", cell=cell).collect())) == want
    one = df.where(g.intersects(box, queries[0][1:])).select("id").collect()
    assert sorted(r["id"] for r in one) == [b for a, b in want if a == queries[0][0]]


def test_greedy_groups(spark):
    r = random.Random(5)
    rows = [(f, i, x, x + 0.1, y, y + 0.1) for f in (1, 2) for i, (x, y) in enumerate((r.random(), r.random()) for _ in range(50))]
    got = grouping.group_boxes(spark.createDataFrame(rows, "f long, i long, a double, b double, c double, d double").repartition(3), ("a", "b", "c", "d"), "f", "i", 0.2)
    want = []
    for f in (1, 2):
        cur, n, number = None, 0, 0
        for _, _, a, b, c, d in (r for r in rows if r[0] == f):
            up = (min(cur[0], a), max(cur[1], b), min(cur[2], c), max(cur[3], d)) if cur else (a, b, c, d)
            if cur and (up[1] - up[0]) * (up[3] - up[2]) > 0.2:
                want.append((f, number, *cur, n))
                cur, n, number = (a, b, c, d), 1, number + 1
            else:
                cur, n = up, n + 1
        want.append((f, number, *cur, n))
    assert sorted(map(tuple, got.collect())) == want


def test_codings(spark):
    xs = [0, 1, 127, 128, 300, 2**31, 2**63 - 1, -1, -(2**63)]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    c = F.col("x")
    out = df.select(c, coding.to_fixed64(c).alias("f"), coding.to_varint(c).alias("v"), coding.to_fixed32(c).alias("h"), coding.to_zigzag(c).alias("z")).withColumns(
        {"f2": coding.fixed64(F.col("f")), "v2": coding.varint(F.col("v")), "z2": coding.zigzag(F.col("z")), "h2": coding.fixed32(F.col("h"))}
    )
    for r in out.collect():
        u, want = r["x"] % 2**64, b""
        assert bytes(r["f"]) == struct.pack("<Q", u) and bytes(r["h"]) == struct.pack("<I", u % 2**32)
        while u >= 128:
            want, u = want + bytes([u % 128 + 128]), u // 128
        assert bytes(r["v"]) == want + bytes([u])
        assert (r["f2"], r["v2"], r["z2"], r["h2"]) == (r["x"], r["x"], r["x"], r["x"] % 2**32)
    assert [spark.range(1).select(coding.to_zigzag(F.lit(x).cast("long"))).first()[0] for x in (0, -1, 1, -2)] == [0, 1, 2, 3]
    assert spark.range(1).select(coding.varint(F.lit(b"\x80"))).first()[0] is None


def test_merge_operators(spark):
    def fold(name, values, kind):
        rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], f"k long, s long, v {kind}")
        return merge.fold(rows, Log(("k",), "s", ("v",)), name).first()["value"]

    big = 2**62
    assert fold("sum", [big, big, big], "long") == 3 * big - 2**64
    assert fold("mul", [big, 8], "long") == 0 and fold("mul", [-3, 5], "long") == -15
    assert bytes(fold("bytesxor", [b"\x01\x02", b"\x01\x00\x07"], "binary")) == b"\x00\x02\x07"
    assert fold("max", ["9", "10"], "string") == "9"
    five = struct.pack("<Q", 5)
    assert bytes(fold("uint64add", [five, b"xx", five], "binary")) == struct.pack("<Q", 10)
    rows = spark.createDataFrame(random_log(8), SCHEMA)
    merge.register("slow_sum", merge.FOLDS["sum"])
    slow, fast = merge.fold(rows, LOG, "slow_sum"), merge.fold(rows, LOG, "sum")
    assert sorted(map(tuple, slow.collect())) == sorted(map(tuple, fast.collect()))
    merge.register_aggregator("last", lambda a, x: x)
    r = merge.agg_merge(spark.createDataFrame([(1, 1, "last", 5), (1, 2, "last", 9)], "k long, s long, f string, v long"), Log(("k",), "s"), "f", "v").first()
    assert (r["value"], r["status"]) == (9, "ok")
    r = merge.agg_merge(spark.createDataFrame([(1, 1, "sum", 5), (1, 2, "nope", 9)], "k long, s long, f string, v long"), Log(("k",), "s"), "f", "v").first()
    assert (r["value"], r["status"], r["packed"]) == (None, "error", [5, 9])


def test_histogram_buckets(spark):
    assert trace.bucket_limits()[:16] == [1, 2, 3, 4, 6, 10, 15, 22, 34, 51, 76, 110, 170, 250, 380, 580]
    two = spark.createDataFrame([(0,), (1,)], "v long")
    assert abs(trace.bucket_histogram(two, "v").first()["p50"] - 0.5) < 1e-9
    many = trace.bucket_histogram(spark.range(1, 111).select(F.col("id").alias("v")), "v").first()
    assert many["n"] == 110 and abs(many["mean"] - 55.5) < 1e-9 and 50 < many["p50"] < 60 and many["p99"] <= 110
    assert trace.bucket_histogram(two.limit(0), "v", "v").count() == 0


def test_cache_policies():
    r = random.Random(3)
    blocks = [min(int(r.paretovariate(0.7)), 400) for _ in range(3000)]
    sizes = [1 + b % 5 for b in blocks]
    missed = {p: cachesim.misses(blocks, sizes, 60, p) for p in caches.POLICIES}
    assert all(len(set(blocks)) <= m <= len(blocks) for m in missed.values())
    assert missed["hybrid"] == missed["lru"] and missed["prioritized"] == missed["lru"]
    for name, cls in caches.POLICIES.items():
        cache = cls(60)
        for b, s in zip(blocks, sizes, strict=True):
            cache.access(b, s, None)
            assert cache.used == sum(cache.held.values()) <= 60, name
        assert not cls(3).access("x", 5) and not cls(3).held
    ones = [1] * len(blocks)
    opt = cachesim.misses(blocks, ones, 20, "opt")
    assert all(opt <= cachesim.misses(blocks, ones, 20, p) for p in caches.POLICIES)
    rows = caches.Hybrid(100)
    assert not rows.access("b1", 10, label="row:k:2") and rows.access("b1", 10, label="row:k:2") and rows.access("b9", 10, label="row:k:2")


def test_lfu_and_opt_against_scans():
    r = random.Random(1)
    blocks = [r.randrange(30) for _ in range(800)]
    for policy in ("lfu", "opt"):
        held, missed, count = {}, 0, {}
        for i, b in enumerate(blocks):
            count[b] = count.get(b, 0) + 1
            if b not in held:
                missed += 1
                if len(held) == 8:
                    later = lambda x: next((j for j in range(i + 1, len(blocks)) if blocks[j] == x), 10**9)  # noqa: B023, E731
                    held.pop(min(held, key=lambda x: (count[x], held[x])) if policy == "lfu" else max(held, key=lambda x: (later(x), -held[x])))
                held[b] = i
        assert cachesim.misses(blocks, [1] * len(blocks), 8, policy) == missed


def test_backups(spark, tmp_path):
    df = spark.createDataFrame(random_log(5), SCHEMA)
    b = archive.Backups(spark, f"file://{tmp_path}/b", LOG)
    assert b.list().count() == 0
    assert [b.create(df.where("s <= 100")), b.create(df.where("s <= 200")), b.create(df)] == [1, 2, 3]
    rows = lambda x: sorted(map(tuple, x.select("k", "s", "op", "v").collect()))
    assert rows(b.restore(2)) == rows(df.where("s <= 200")) and rows(b.restore()) == rows(df)
    b.purge(1)
    assert [r["version"] for r in b.list().collect()] == [3] and rows(b.restore()) == rows(df)
    with pytest.raises(ValueError):
        b.restore(1)
    spark.createDataFrame([(1, 250, "put", 5)], SCHEMA).write.mode("overwrite").parquet(f"file://{tmp_path}/b/data/v=3")
    assert [r["ok"] for r in b.verify().where("version = 3").collect()] == [False]
    with pytest.raises(ValueError):
        b.restore()


def test_files(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    layout.write_sorted(spark.range(100).select("id"), at, "id", files=4)
    sums = layout.file_checksums(spark, at)
    sums = spark.createDataFrame(sums.collect(), sums.schema)
    assert {r["status"] for r in archive.verify_files(spark, at, sums).collect()} == {"ok"}
    first = archive.files(spark, at).orderBy("file").first()["file"]
    assert archive.oldest_file(spark, at).first()["oldest"] is not None
    assert archive.delete(spark, first) and not archive.exists(spark, first)
    assert sorted(r["status"] for r in archive.verify_files(spark, at, sums).collect()) == ["missing", "ok", "ok", "ok"]
    assert archive.tables(spark, f"file://{tmp_path}") == ["t"]
    extensions.write_filtered(spark.range(50), f"{at}2", "id", rows=50)
    assert spark.read.parquet(f"{at}2").where("id = 7").count() == 1
    extensions.write_partitioned(spark.range(50).select(F.col("id").cast("string").alias("k")), f"{at}3", "k", "prefix1")
    assert spark.read.parquet(f"{at}3").count() == 50
    extensions.register_collector("total", lambda: F.sum("id"))
    seen_df, seen = extensions.collected(spark.range(5))
    seen_df.write.mode("overwrite").parquet(f"{at}4")
    assert seen.get == {"entries": 5, "total": 10}
    extensions.COLLECTORS.clear()
    assert [r["k"] for r in extensions.order_by(spark.createDataFrame([("bb",), ("c",)], "k string"), "k", "length_then_bytes").collect()] == ["c", "bb"]


def test_ttl_in_a_stream(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    d = Log(key=("k",), seq="s", value=("v",), ts="t")
    schema = "k long, s long, v long, t timestamp"
    for i, rows in enumerate([[(1, 1, 10, at(0)), (2, 2, 20, at(5))], [(2, 3, 21, at(100)), (1, 0, 9, at(3))], [(3, 9, 1, at(500))], [(3, 10, 2, at(501))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    events = []
    listener = extensions.Events(started=lambda e: events.append("started"))
    extensions.listen(spark, listener)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = feed.live(src, d, "k long, t timestamp, s long, v long", 60).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(90)
    spark.streams.removeListener(listener)
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    values = sorted((r["k"], r["v"]) for r in out if not r["expired"])
    assert (1, 10) in values and (2, 20) in values and (2, 21) in values and (1, 9) not in values
    assert {r["k"] for r in out if r["expired"]} >= {1}
    assert events == ["started"]


def test_command_line(spark, tmp_path):
    db = f"file://{tmp_path}/db"

    def run(*args):
        out = io.StringIO()
        code = cli.main(["--db", db, *args], spark, out)
        return code, out.getvalue()

    assert run("batchput", "a", "1", "b", "2", "c", "3")[0] == 0
    run("merge", "a", "x")
    run("delete", "b")
    run("put", "d", "4")
    run("deleterange", "c", "d")
    assert run("get", "a") == (0, "1,x\n") and run("get", "b")[0] == 1 and run("get", "c")[0] == 1
    assert run("get", "b", "--seq", "3") == (0, "2\n")
    assert run("scan")[1] == "a\t1,x\nd\t4\n" and run("dump", "--max_keys", "1")[1] == "a\t1,x\nKeys in range: 1\n"
    assert run("checkconsistency") == (0, "OK\n") and run("get_property", "latest-sequence")[1] == "7\n"
    assert run("query", "SELECT count(*) FROM log")[1] == "7\n" and run("list_file_range_deletes")[1] == "c\td\t7\n"
    assert len(run("idump")[1].splitlines()) == 7 and len(run("dump_wal", "--since", "6")[1].splitlines()) == 2
    assert run("backup", f"{db}-b")[1] == "1\n"
    run("dump_table", f"{db}-d")
    run("write_extern_sst", f"{db}-x")
    before = run("scan")[1]
    run("compact")
    assert run("scan")[1] == before and len(run("idump")[1].splitlines()) == 2
    run("put", "e", "5")
    run("restore", f"{db}-b")
    assert run("scan")[1] == before
    db = f"file://{tmp_path}/db2"
    run("load", f"file://{tmp_path}/db-d")
    assert run("scan")[1] == before
    run("ingest_extern_sst", f"file://{tmp_path}/db-x")
    assert run("scan")[1] == before and run("list_tables")[1] == "log\n" and run("list_live_files_metadata")[1] and run("file_checksum_dump")[1] and run("approxsize")[1]
