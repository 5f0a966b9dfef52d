"""Queries over writes, compaction, merge operators, joins and copies of tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kvlog.functions import coding
from kvlog.functions import geometry as g
from kvlog.operators import asof, compact, merge, overlay, resolve, ttl, wide, writes
from kvlog.operators.schema import Log
from kvlog.plans.catalog import _CENTS, _LIVE, _OPS_SQL, _TOMBS, BOX, EVENTS, OPS, _boxes, _cents, _events, _newest, _ops, _t, _tombs, query
from kvlog.sources import archive, layout
from kvlog.sources.package import scratch

# --- writes


@query("batch_savepoint", "SELECT op, count(*) AS n FROM (SELECT CASE event_type WHEN 'signup' THEN 'put' WHEN 'error' THEN 'delete' ELSE 'merge' END AS op FROM events WHERE event_id < (SELECT count(*) // 2 FROM events)) GROUP BY 1")
def _(spark, d):
    batch = _ops(spark, d)
    return overlay.batch_counts(writes.rollback(batch, "event_id", batch.count() // 2), "op")


@query("batch_commit", "SELECT user_id, seq, op FROM (SELECT user_id, event_id AS seq, op FROM _ops UNION ALL SELECT user_id, (SELECT max(event_id) FROM _ops) + row_number() OVER (ORDER BY event_id), op FROM _ops WHERE event_id % 2 = 0)".replace("_ops", _OPS_SQL))
def _(spark, d):
    log = _ops(spark, d).select("user_id", F.col("event_id").alias("seq"), "op")
    batch = _ops(spark, d).where("event_id % 2 = 0").select(F.col("event_id").alias("ordinal"), "user_id", "op")
    return writes.commit(log, writes.checked(batch.withColumns({"key": F.lit(""), "end": F.lit("")}), "sum").drop("key", "end"))


@query("put_entity", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS n_columns, o_orderstatus AS value, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS priority FROM orders")
def _(spark, d):
    columns = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit(""), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority")))
    e = _t(spark, d, "orders").select("o_orderkey", wide.entity(F.col("o_orderstatus"), columns).alias("c"))
    return e.select("o_orderkey", F.size("c").alias("n_columns"), wide.plain_value(F.lit(None).cast("string"), F.col("c")).alias("value"), wide.column(F.col("c"), "priority").alias("priority"))


@query("kv_get_resolved", f"SELECT user_id, event_id, op, cents FROM {_newest('user_id', table=_OPS_SQL)} WHERE op <> 'delete' AND user_id = 7")
def _(spark, d):
    return resolve.latest(_ops(spark, d).where("user_id = 7"), OPS)


@query("updates_since", "SELECT b AS batch, min(event_id) AS first, count(*) AS n, string_agg(event_type, ',' ORDER BY event_id) AS ops FROM (SELECT *, event_id // 16 AS b FROM events) GROUP BY 1 HAVING max(event_id) >= 700")
def _(spark, d):
    log = _events(spark, d).withColumn("batch", F.floor(F.col("event_id") / 16).cast("long"))
    out = overlay.batches_since(log, "event_id", 700, "batch", "event_type")
    return out.select("batch", "first", F.size("ops").cast("long").alias("n"), F.array_join(F.transform("ops", lambda x: x["event_type"]), ",").alias("ops"))


@query("txn_prepared", "SELECT event_id FROM events WHERE event_type = 'view' OR user_id IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def _(spark, d):
    e = _events(spark, d)
    log = e.select("event_id", F.when(F.col("event_type") != "view", F.col("user_id")).alias("txn"))
    return writes.prepared(log, e.where("event_type = 'signup'").select(F.col("user_id").alias("txn")), "txn").select("event_id")


@query("log_filter", "SELECT event_id, user_id FROM events WHERE event_type <> 'error' AND event_id < coalesce((SELECT min(event_id) FROM events WHERE value > 200 AND event_type <> 'error'), 1e18)")
def _(spark, d):
    decision = F.when(F.col("event_type") == "error", "ignore").when(F.col("value") > 200, "stop").otherwise("keep")
    return writes.recover(_events(spark, d), "event_id", decision).select("event_id", "user_id")


@query("replay_trace", f"SELECT user_id, CAST(sum(cents) AS BIGINT) AS value FROM (SELECT *, max(CASE WHEN op <> 'merge' THEN event_id END) OVER (PARTITION BY user_id) AS b FROM {_OPS_SQL}) t WHERE (b IS NULL OR event_id >= b) AND op <> 'delete' GROUP BY 1")
def _(spark, d):
    batch = writes.replay(_ops(spark, d), "event_id", F.col("op"))
    return merge.fold_fast(batch, Log(key=("user_id",), seq="ordinal", value=("cents",), op="op"), "sum")


# --- compaction

_STRIPES = f"""
r AS (SELECT *, CASE WHEN event_id <= 300 THEN 300 WHEN event_id <= 700 THEN 700 ELSE 4611686018427387904 END AS st FROM {_OPS_SQL}),
t AS (SELECT *, CASE WHEN s <= 300 THEN 300 WHEN s <= 700 THEN 700 ELSE 4611686018427387904 END AS st FROM {_TOMBS} t(b, e, s)),
alive AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.st = r.st AND user_id >= t.b AND user_id < t.e AND t.s > event_id)),
w AS (SELECT *, max(CASE WHEN op <> 'merge' THEN event_id END) OVER (PARTITION BY user_id, st) AS base, max(event_id) OVER (PARTITION BY user_id, st) AS top, min(st) OVER (PARTITION BY user_id) AS low FROM alive),
k AS (SELECT * FROM w WHERE base IS NULL OR event_id >= base)"""


@query("compaction_snapshots", f"WITH {_STRIPES} SELECT user_id, event_id, op, cents FROM k WHERE NOT (op = 'delete' AND st = 300)")
def _(spark, d):
    out = compact.compact(_ops(spark, d), OPS, tombstones=_tombs(spark), snapshots=(300, 700))
    return out.select("user_id", "event_id", "op", "cents")


@query(
    "compaction_merge",
    f"""WITH {_STRIPES},
f AS (SELECT user_id, st, event_id, op, cents FROM k WHERE base = top
      UNION ALL SELECT user_id, st, event_id, op, cents FROM k WHERE (base IS NULL OR base < top) AND NOT (base IS NOT NULL OR st = low)
      UNION ALL SELECT user_id, st, max(top), 'put', CAST(sum(CASE WHEN op <> 'delete' THEN cents END) AS BIGINT) FROM k WHERE (base IS NULL OR base < top) AND (base IS NOT NULL OR st = low) GROUP BY 1, 2)
SELECT user_id, event_id, op, cents FROM f WHERE NOT (op = 'delete' AND st = 300)""",
)
def _(spark, d):
    out = compact.compact(_ops(spark, d), OPS, tombstones=_tombs(spark), snapshots=(300, 700), fold="sum")
    return out.select("user_id", "event_id", "op", "cents")


@query("filter_merge_operand", f"SELECT user_id, event_id, 'put' AS op, cents FROM (SELECT user_id, max(event_id) AS event_id, CAST(sum(CASE WHEN op <> 'delete' THEN cents END) AS BIGINT) AS cents, bool_and(op = 'delete') AS gone FROM (SELECT *, max(CASE WHEN op <> 'merge' THEN event_id END) OVER (PARTITION BY user_id) AS b FROM {_OPS_SQL} WHERE op <> 'merge' OR cents >= 5000) WHERE b IS NULL OR event_id >= b GROUP BY 1) WHERE NOT gone")
def _(spark, d):
    out = compact.compact(_ops(spark, d), OPS, drop_operand=F.col("cents") < 5000, fold="sum")
    return out.select("user_id", "event_id", "op", "cents")


@query(
    "compaction_decisions",
    f"""WITH n AS (SELECT user_id, event_id, cents, cents % 5 AS c FROM {_newest('user_id', table=_OPS_SQL)}),
s AS (SELECT user_id AS b, user_id + 3 AS e FROM n WHERE c = 2)
SELECT user_id, event_id, CASE WHEN c = 1 THEN cents + 1 ELSE cents END AS cents FROM n
WHERE c IN (1, 4) AND NOT EXISTS (SELECT 1 FROM s WHERE user_id >= b AND user_id < e)""",
)
def _(spark, d):
    def decide(rows):
        c = F.col("cents") % 5
        choice = F.when(c == 0, compact.REMOVE).when(c == 1, compact.CHANGE_VALUE).when(c == 2, compact.SKIP_UNTIL).when(c == 3, compact.PURGE).otherwise(compact.KEEP)
        return choice, F.col("cents") + 1, F.col("user_id") + 3

    log = _cents(spark, d).withColumn("op", F.lit("put"))
    return compact.compact(log, OPS, decide=decide).select("user_id", "event_id", "cents")


@query(
    "compact_files",
    f"""SELECT user_id, event_id, op, cents FROM (SELECT *, max(CASE WHEN op <> 'merge' THEN event_id END) OVER (PARTITION BY user_id) AS b FROM {_OPS_SQL})
        WHERE user_id BETWEEN 10 AND 60 AND (b IS NULL OR event_id >= b) OR user_id NOT BETWEEN 10 AND 60""",
)
def _(spark, d):
    chosen = F.col("user_id").between(10, 60)
    log = _ops(spark, d).select("user_id", "event_id", "op", "cents")
    return compact.compact(log.where(chosen), OPS, bottom=False).unionByName(log.where(~chosen))


@query("evict_by_age", "SELECT o_orderkey FROM orders WHERE NOT (o_orderkey + 5000 < (SELECT max(o_orderkey) FROM orders))")
def _(spark, d):
    files = _t(spark, d, "orders")
    now = files.agg(F.max("o_orderkey")).first()[0]
    return compact.evict_by_age(files, "o_orderkey", F.lit(now), 5000).select("o_orderkey")


# --- time to live

_TTL = "CASE event_type WHEN 'view' THEN 0 ELSE 2000 END"
_TIMED = Log(key=("user_id",), seq="event_id", value=("cents",), ts="at", op="op")


def _timed(spark, d):
    return _ops(spark, d).select("user_id", "event_id", "op", "cents", F.col("event_id").alias("at"))


for _name, _where in (("ttl_read_lenient", ""), ("ttl_read_strict", " AND NOT (event_id + 5000 < 9000)")):

    @query(_name, f"SELECT user_id, event_id, cents FROM {_newest('user_id', table=_OPS_SQL)} WHERE op <> 'delete'{_where}")
    def _(spark, d, strict=bool(_where)):
        return ttl.read(_timed(spark, d), _TIMED, F.lit(5000), F.lit(9000), strict).select("user_id", "event_id", "cents")


@query("ttl_merge", f"SELECT user_id, CAST(sum(cents) AS BIGINT) AS value, max(top) AS at FROM (SELECT *, max(CASE WHEN op <> 'merge' THEN event_id END) OVER (PARTITION BY user_id) AS b, max(event_id) OVER (PARTITION BY user_id) AS top FROM {_OPS_SQL} WHERE NOT (event_id + 5000 < 9000)) t WHERE (b IS NULL OR event_id >= b) AND op <> 'delete' GROUP BY 1")
def _(spark, d):
    return ttl.merge(_timed(spark, d), _TIMED, "sum", F.lit(5000), F.lit(9000)).select("user_id", "value", "at")


# --- merge operators

_SIGNED = "CAST(CASE WHEN m >= 9223372036854775808::HUGEINT THEN m - 18446744073709551616::HUGEINT ELSE m END AS BIGINT)"
_MOD = "18446744073709551616::HUGEINT"


@query("merge_mul", f"SELECT user_id, {_SIGNED} AS value FROM (SELECT user_id, list_reduce(list_prepend(1::HUGEINT, list((1 + event_id % 3)::HUGEINT ORDER BY event_id)), lambda a, x: (a * x) % {_MOD}) AS m FROM events GROUP BY 1)")
def _(spark, d):
    rows = _events(spark, d).select("user_id", "event_id", (1 + F.col("event_id") % 3).alias("cents"))
    return merge.fold(rows, _CENTS, "mul")


@query("merge_sum_wraps", f"SELECT user_id, {_SIGNED} AS value FROM (SELECT user_id, (((sum(cents::HUGEINT * 4000000000000000) % {_MOD}) + {_MOD}) % {_MOD})::HUGEINT AS m FROM {_OPS_SQL} GROUP BY 1)")
def _(spark, d):
    return merge.fold_fast(_cents(spark, d).withColumn("cents", merge.wrapped(F.col("cents").cast("decimal(20,0)") * F.lit(4000000000000000).cast("decimal(18,0)"))), _CENTS, "sum")


@query("merge_uint64add", f"SELECT user_id, CAST(sum(CASE WHEN event_id % 4 <> 0 THEN cents ELSE 0 END) AS BIGINT) AS value FROM {_OPS_SQL} GROUP BY 1")
def _(spark, d):
    operand = F.when(F.col("event_id") % 4 != 0, coding.to_fixed64(F.col("cents"))).otherwise(F.lit(b"bad"))
    rows = _cents(spark, d).select("user_id", "event_id", operand.alias("cents"))
    return merge.fold(rows, _CENTS, "uint64add").select("user_id", coding.fixed64(F.col("value")).alias("value"))


@query("merge_max_bytes", "SELECT user_id, max(CAST(event_id AS VARCHAR)) AS value FROM events GROUP BY 1")
def _(spark, d):
    rows = _events(spark, d).select("user_id", "event_id", F.col("event_id").cast("string").cast("binary").alias("cents"))
    return merge.fold(rows, _CENTS, "max").select("user_id", F.col("value").cast("string").alias("value"))


@query("merge_bytesxor", "SELECT user_id, CAST(bit_xor(event_id) AS BIGINT) AS value FROM events GROUP BY 1")
def _(spark, d):
    rows = _events(spark, d).select("user_id", "event_id", coding.to_fixed64(F.col("event_id")).alias("cents"))
    return merge.fold(rows, _CENTS, "bytesxor").select("user_id", coding.fixed64(F.col("value")).alias("value"))


@query("merge_append_delimiter", "SELECT user_id, string_agg(event_type, ' | ' ORDER BY event_id) AS value FROM events GROUP BY 1")
def _(spark, d):
    merge.register("append_bar", merge.appending(" | "))
    return merge.fold(_events(spark, d), Log(key=("user_id",), seq="event_id", value=("event_type",)), "append_bar")


# --- wide columns


@query(
    "wide_collect_garbage",
    """SELECT user_id, sum(CAST(event_type <> 'view' OR event_id + 100 >= 9000 AS INT))::BIGINT AS columns FROM events
       WHERE NOT (event_type = 'error' AND event_id + 2000 < 9000) GROUP BY 1 HAVING sum(CAST(event_type <> 'view' OR event_id + 100 >= 9000 AS INT)) > 0""",
)
def _(spark, d):
    kind = F.when(F.col("event_type") == "view", "expiring").when(F.col("event_type") == "error", "tombstone").otherwise("column")
    c = F.struct(kind.alias("kind"), F.col("event_type").alias("idx"), F.col("event_id").alias("ts"), F.col("value"), F.lit(100).alias("ttl"))
    rows = _events(spark, d).groupBy("user_id").agg(F.collect_list(c).alias("c"))
    left = rows.select("user_id", wide.purge_expired(wide.collect_tombstones(F.col("c"), F.lit(9000), 2000), F.lit(9000)).alias("c"))
    return left.where(wide.live_rows(F.col("c"))).select("user_id", F.size("c").cast("long").alias("columns"))


# --- joins and predicates


@query("asof_join", "SELECT p.event_id, p.user_id, v.event_id AS seen, v.value AS seen_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.event_id >= v.event_id")
def _(spark, d):
    e = _events(spark, d)
    views = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("seen"), F.col("value").alias("seen_value"))
    return asof.asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id"), views, "user_id", "event_id", "seen", ["seen", "seen_value"])


for _name, _order in (("merge_runs_ordered", True), ("merge_runs_unordered", False)):

    @query(_name, "SELECT user_id, event_id, value FROM events" + (" ORDER BY user_id, event_id" if _order else ""))
    def _(spark, d, ordered=_order):
        runs = [_events(spark, d).where(F.col("event_id") % 3 == i).select("user_id", "event_id", "value") for i in range(3)]
        return asof.merge_ordered(runs, "user_id", "event_id") if ordered else asof.merge_unordered(runs)


@query("interval_overlap", "SELECT event_id FROM events WHERE value <= 60 AND value + 10 >= 20")
def _(spark, d):
    e = _events(spark, d).select("event_id", F.col("value").alias("lo"), (F.col("value") + 10).alias("hi"))
    return e.where(g.ranges_overlap("lo", "hi", (20.0, 60.0))).select("event_id")


@query("value_range_union", "SELECT user_id, min(value) AS lo, max(value + 10) AS hi FROM events GROUP BY 1")
def _(spark, d):
    return _events(spark, d).groupBy("user_id").agg(F.min("value").alias("lo"), F.max(F.col("value") + 10).alias("hi"))


@query("mbr_extent", "SELECT l_returnflag, round((max(l_quantity) + 1 - min(l_quantity)) * (max(l_discount + l_tax) - min(l_discount)), 6) AS area, round(2 * ((max(l_quantity) + 1 - min(l_quantity)) + (max(l_discount + l_tax) - min(l_discount))), 6) AS perimeter FROM lineitem GROUP BY 1")
def _(spark, d):
    u = _boxes(spark, d).groupBy("l_returnflag").agg(*[f(c).alias(c) for f, c in zip((F.min, F.max, F.min, F.max), BOX, strict=True)])
    own = tuple(map(F.col, BOX))
    return u.select("l_returnflag", F.round(g.area(*own), 6).alias("area"), F.round(g.perimeter(*own), 6).alias("perimeter"))


@query("zorder_compare", "SELECT l_orderkey, l_linenumber, l_partkey, " + " + ".join(f"((((l_orderkey % 256) >> {i}) & 1) << {2 * i + 1}) + ((((l_partkey % 256) >> {i}) & 1) << {2 * i})" for i in range(8)) + " < " + " + ".join(f"((((l_suppkey % 256) >> {i}) & 1) << {2 * i + 1}) + (((l_linenumber >> {i}) & 1) << {2 * i})" for i in range(8)) + " AS before FROM lineitem")
def _(spark, d):
    a = (F.col("l_orderkey") % 256, F.col("l_partkey") % 256)
    b = (F.col("l_suppkey") % 256, F.col("l_linenumber").cast("long"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", g.z_less(a, b, 8).alias("before"))


@query("hilbert_cell", "SELECT l_orderkey, l_partkey, l_orderkey % 256 AS x, l_partkey % 256 AS y FROM lineitem")
def _(spark, d):
    h = g.hilbert_udf(8)(F.col("l_orderkey") % 256, F.col("l_partkey") % 256)
    return _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", g.hilbert_cell_udf(8)(h).alias("c")).select("l_orderkey", "l_partkey", "c.x", "c.y")


@query("hex_keys", "SELECT c_custkey, hex(c_name) AS digits, c_name AS back FROM customer")
def _(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", coding.hex_key(F.col("c_name")).alias("digits"))
    return rows.withColumn("back", coding.from_hex_key(F.col("digits")))


@query("byte_codings", "SELECT event_id, event_id AS fixed64, event_id & 4294967295 AS fixed32, event_id * 1000003 AS varint, -event_id AS zigzag, event_type AS slice, CASE WHEN event_id = 0 THEN 1 ELSE CAST(floor(log2(event_id * 1000003) / 7) AS INT) + 1 END AS varint_bytes FROM events")
def _(spark, d):
    i = F.col("event_id")
    v = coding.to_varint(i * 1000003)
    return _events(spark, d).select(
        i, coding.fixed64(coding.to_fixed64(i)).alias("fixed64"), coding.fixed32(coding.to_fixed32(i)).alias("fixed32"), coding.varint(v).alias("varint"), coding.zigzag(coding.varint(coding.to_varint(coding.to_zigzag(-i)))).alias("zigzag"), coding.get_length_prefixed(coding.length_prefixed(F.col("event_type").cast("binary"))).cast("string").alias("slice"), coding.varint_length(v).alias("varint_bytes")
    )


# --- files and copies


def _folder(spark, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


@query("table_filter", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey >= (SELECT max(o_orderkey) // 2 FROM orders) GROUP BY 1")
def _(spark, d):
    o = _t(spark, d, "orders")
    half = o.agg(F.max("o_orderkey")).first()[0] // 2
    at = _folder(spark, "orders")
    layout.write_sorted(o, at, "o_orderkey", files=8)
    stats = archive.file_stats(spark, at, "o_orderkey", [])
    return archive.read_files(spark, at, F.col("largest") >= half, stats).where(F.col("o_orderkey") >= half).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("backup_restore", "SELECT user_id, event_id, cents FROM " + _OPS_SQL)
def _(spark, d):
    log = _cents(spark, d)
    b = archive.Backups(spark, _folder(spark, "backup"), _CENTS)
    b.create(log.where("event_id < 400"))
    return b.restore(b.create(log))


@query("export_import", "SELECT * FROM supplier")
def _(spark, d):
    at = _folder(spark, "export")
    archive.export_table(_t(spark, d, "supplier"), at, "s_suppkey")
    return archive.import_table(spark, at)


@query("dump_undump", "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS value FROM customer")
def _(spark, d):
    at = _folder(spark, "dump")
    archive.dump(_t(spark, d, "customer"), at, "c_custkey", "c_name")
    return archive.undump(spark, at)


@query("prefix_files", "SELECT substr(CAST(user_id AS VARCHAR), 1, 1) AS prefix, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    at = _folder(spark, "prefix")
    archive.write_by_prefix(_events(spark, d).select("user_id", "event_id"), at, "user_id", 1)
    return spark.read.option("recursiveFileLookup", "false").parquet(at).groupBy(F.col("prefix").cast("string").alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


_TEXTS = Log(key=("doc_id",), seq="doc_id", value=("text",))


@query("blob_separation", "SELECT doc_id, octet_length(encode(text)) AS bytes FROM documents")
def _(spark, d):
    log, blobs = archive.separate(_t(spark, d, "documents").select("doc_id", "text"), _TEXTS, 1000)
    back = archive.resolve_blobs(log, archive.collect_blobs(log, blobs), _TEXTS)
    return back.select("doc_id", F.octet_length("text").cast("long").alias("bytes"))


@query("blob_stats", "SELECT octet_length(encode(text)) >= 1000 AS out_of_line, count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL GROUP BY 1")
def _(spark, d):
    return archive.blob_stats(_t(spark, d, "documents"), "text", 1000)


@query("live_files", "SELECT count(*) AS n, min(event_id) AS smallest, max(event_id) AS largest, CAST(sum(CAST(op = 'put' AS INT)) AS BIGINT) AS puts, CAST(sum(CAST(op = 'delete' AS INT)) AS BIGINT) AS deletes, CAST(sum(CAST(op = 'merge' AS INT)) AS BIGINT) AS merges FROM " + _OPS_SQL)
def _(spark, d):
    at = _folder(spark, "live")
    layout.write_sorted(_ops(spark, d), at, "event_id", files=4)
    f = archive.file_stats(spark, at, "event_id", ["cents"], "op")
    return f.agg(F.sum("rows").alias("n"), F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), *[F.sum(c).alias(c) for c in ("puts", "deletes", "merges")])


@query("verify_files", "SELECT 'ok' AS status, CAST(4 AS BIGINT) AS files")
def _(spark, d):
    at = _folder(spark, "verify")
    layout.write_sorted(_cents(spark, d), at, "event_id", files=4)
    found = archive.verify_files(spark, at, layout.file_checksums(spark, at))
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


@query("range_delete_sequence", f"SELECT event_id, user_id FROM events WHERE event_id <= 900 AND {_LIVE}")
def _(spark, d):
    from kvlog.operators import ranges

    return ranges.apply_tombstones(_events(spark, d), _tombs(spark), EVENTS, 900, broadcast_up_to=0).select("event_id", "user_id")
