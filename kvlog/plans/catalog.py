"""Query registry: name -> callable(spark, sf_dir), and name -> equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvlog.functions import geometry as g
from kvlog.operators import cachesim, compact, merge, overlay, ranges, resolve, secondary, trace, wide
from kvlog.operators.schema import Log

QUERIES: dict = {}
ORACLE_SQL: dict = {}

EVENTS = Log(key=("user_id",), seq="event_id", value=("value",), ts="ts")
PAIRS = Log(key=("user_id", "event_type"), seq="event_id", value=("value",), ts="ts")
#: events as an operation log: signup puts, error deletes, all others merge.
OPS = Log(key=("user_id",), seq="event_id", value=("cents",), op="op")
SNAPSHOT = 500
BOX = ("xmin", "xmax", "ymin", "ymax")


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark, d):
    return _t(spark, d, "events")


def _ops(spark, d):
    op = F.when(F.col("event_type") == "signup", "put").when(F.col("event_type") == "error", "delete").otherwise("merge")
    return _events(spark, d).select("user_id", "event_id", op.alias("op"), F.round(F.col("value") * 100).cast("long").alias("cents"), "ts")


_OPS_SQL = "(SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'put' WHEN 'error' THEN 'delete' ELSE 'merge' END AS op, CAST(round(value * 100) AS BIGINT) AS cents, ts FROM events)"


def _boxes(spark, d):
    return _t(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", F.col("l_quantity").alias("xmin"), (F.col("l_quantity") + 1).alias("xmax"), F.col("l_discount").alias("ymin"), (F.col("l_discount") + F.col("l_tax")).alias("ymax")
    )


_BOXES_SQL = "(SELECT *, l_quantity AS xmin, l_quantity + 1 AS xmax, l_discount AS ymin, l_discount + l_tax AS ymax FROM lineitem)"
_ROW = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
_ROW_SQL = ", ".join(_ROW)


def _newest(key: str, where: str = "", table: str = "events", order: str = "event_id") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order} DESC) rn FROM {table} {where}) WHERE rn = 1)"


# --- key lookups and scans


@query("kv_get", "SELECT * FROM orders WHERE o_orderkey = 7")
def _(spark, d):
    return _t(spark, d, "orders").where(F.col("o_orderkey") == 7)


@query("kv_multiget", f"SELECT k.user_id, event_id, value, ts, CASE WHEN event_id IS NULL THEN 'not_found' ELSE 'ok' END AS status FROM (VALUES (CAST(1 AS BIGINT)), (3), (5), (999999)) k(user_id) LEFT JOIN {_newest('user_id')} e USING (user_id)")
def _(spark, d):
    keys = spark.sql("SELECT explode(array(1L, 3L, 5L, 999999L)) AS user_id")
    return resolve.multi_get(_events(spark, d), keys, EVENTS).select("user_id", "event_id", "value", "ts", "status")


@query("kv_may_exist", "SELECT user_id FROM (VALUES (CAST(1 AS BIGINT)), (3), (999999)) k(user_id) WHERE user_id IN (SELECT user_id FROM events)")
def _(spark, d):
    return resolve.key_may_exist(_events(spark, d), spark.sql("SELECT explode(array(1L, 3L, 999999L)) AS user_id"), EVENTS)


@query("kv_full_scan", f"SELECT user_id, event_id, value, ts FROM {_newest('user_id')} ORDER BY user_id")
def _(spark, d):
    return resolve.latest(_events(spark, d), EVENTS).select("user_id", "event_id", "value", "ts").orderBy("user_id")


@query("kv_seek", "SELECT * FROM part WHERE p_partkey >= 50 ORDER BY p_partkey LIMIT 10")
def _(spark, d):
    return ranges.seek(_t(spark, d, "part"), "p_partkey", 50, 10)


@query("kv_seek_for_prev", "SELECT * FROM part WHERE p_partkey <= 77 ORDER BY p_partkey DESC LIMIT 1")
def _(spark, d):
    return ranges.seek_for_prev(_t(spark, d, "part"), "p_partkey", 77)


@query("kv_scan_bounded", "SELECT * FROM customer WHERE c_custkey >= 20 AND c_custkey < 60")
def _(spark, d):
    return ranges.scan(_t(spark, d, "customer"), "c_custkey", 20, 60)


@query("kv_scan_reverse", "SELECT * FROM customer ORDER BY c_custkey DESC")
def _(spark, d):
    return _t(spark, d, "customer").orderBy(F.desc("c_custkey"))


@query("kv_prefix_scan", "SELECT * FROM customer WHERE starts_with(c_name, 'Customer#00000')")
def _(spark, d):
    return ranges.prefix_scan(_t(spark, d, "customer"), "c_name", "Customer#00000")


@query("prefix_transforms", "SELECT CASE WHEN length(p_name) >= 4 THEN substr(p_name, 1, 4) END AS fixed, substr(p_name, 1, 4) AS capped, count(*) AS n FROM part GROUP BY 1, 2")
def _(spark, d):
    k = F.col("p_name")
    return _t(spark, d, "part").groupBy(ranges.fixed_prefix(k, 4).alias("fixed"), ranges.capped_prefix(k, 4).alias("capped")).agg(F.count(F.lit(1)).alias("n"))


# --- version resolution


@query("latest", f"SELECT user_id, event_type, event_id, value, ts FROM {_newest('user_id, event_type')}")
def _(spark, d):
    return resolve.latest(_events(spark, d), PAIRS).select("user_id", "event_type", "event_id", "value", "ts")


@query("as_of_seq", f"SELECT user_id, event_id, value FROM {_newest('user_id', f'WHERE event_id <= {SNAPSHOT}')}")
def _(spark, d):
    return resolve.latest(_events(spark, d), EVENTS, seq=SNAPSHOT).select("user_id", "event_id", "value")


_MID = "(SELECT ts FROM events WHERE event_id = 600)"


def _mid(spark, d):
    """A literal timestamp of the data: that of one event."""
    return F.lit(_events(spark, d).where("event_id = 600").select("ts").first()[0])


@query("as_of_ts", f"SELECT user_id, event_id, value FROM {_newest('user_id', f'WHERE ts <= {_MID}', order='ts DESC, event_id')}")
def _(spark, d):
    return resolve.latest(_events(spark, d), EVENTS, ts=_mid(spark, d)).select("user_id", "event_id", "value")


@query("history_range", "SELECT user_id, event_id, event_type, value FROM events WHERE ts BETWEEN (SELECT ts FROM events WHERE event_id = 300) AND (SELECT ts FROM events WHERE event_id = 600)")
def _(spark, d):
    low = _events(spark, d).where("event_id = 300").select("ts").first()[0]
    return resolve.history(_events(spark, d), EVENTS, F.lit(low), _mid(spark, d)).select("user_id", "event_id", "event_type", "value")


@query("history_trim", f"SELECT event_id, user_id FROM events WHERE ts <= {_MID}")
def _(spark, d):
    return resolve.trim(_events(spark, d), EVENTS, _mid(spark, d)).select("event_id", "user_id")


@query("history_collapse", f"SELECT event_id, user_id FROM events WHERE ts >= {_MID} UNION ALL SELECT event_id, user_id FROM {_newest('user_id', f'WHERE ts < {_MID}')}")
def _(spark, d):
    return resolve.collapse_below(_events(spark, d), EVENTS, _mid(spark, d)).select("event_id", "user_id")


@query("latest_with_deletes", f"SELECT user_id, event_id, op, cents FROM {_newest('user_id', table=_OPS_SQL)} WHERE op <> 'delete'")
def _(spark, d):
    return resolve.latest(_ops(spark, d), OPS)


@query("snapshot_two_tables", f"SELECT 'pair' AS source, count(*) AS n FROM {_newest('user_id, event_type', f'WHERE event_id <= {SNAPSHOT}')} UNION ALL SELECT 'user', count(*) FROM {_newest('user_id', f'WHERE event_id <= {SNAPSHOT}')}")
def _(spark, d):
    e = _events(spark, d)
    one = lambda log, name: resolve.latest(e, log, seq=SNAPSHOT).agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n"))
    return one(PAIRS, "pair").unionByName(one(EVENTS, "user"))


# --- secondary scans

_RANGE_SQL = "value BETWEEN 20 AND 60"


@query("sec_range_raw", f"SELECT event_id, value FROM events WHERE {_RANGE_SQL}")
def _(spark, d):
    return secondary.secondary_scan(_events(spark, d), PAIRS, g.in_range("value", (20, 60)), "raw").select("event_id", "value")


_LATEST_RANGE = f"SELECT user_id, event_type, event_id, value FROM {_newest('user_id, event_type')} WHERE {_RANGE_SQL}"
for _name, _mode in (("sec_range_latest", "latest"), ("sec_range_memo", "memo"), ("sec_range_two_pass", "two_pass")):

    @query(_name, _LATEST_RANGE)
    def _(spark, d, mode=_mode):
        return secondary.secondary_scan(_events(spark, d), PAIRS, g.in_range("value", (20, 60)), mode).select("user_id", "event_type", "event_id", "value")


_Q = (15.0, 20.0, 0.03, 0.05)
_Q_SQL = "xmax >= 15 AND xmin <= 20 AND ymax >= 0.03 AND ymin <= 0.05"


@query("sec_box_raw", f"SELECT {_ROW_SQL} FROM {_BOXES_SQL} WHERE {_Q_SQL}")
def _(spark, d):
    return _boxes(spark, d).where(g.intersects(BOX, _Q)).select(*_ROW)


@query("sec_box_latest", f"SELECT l_partkey, xmin, ymin FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_suppkey DESC, l_linenumber DESC, l_extendedprice DESC) rn FROM {_BOXES_SQL}) WHERE rn = 1 AND {_Q_SQL}")
def _(spark, d):
    seq = F.struct("l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    log = Log(key=("l_partkey",), seq="seq", value=BOX)
    return secondary.secondary_scan(_boxes(spark, d).withColumn("seq", seq), log, g.intersects(BOX, _Q)).select("l_partkey", "xmin", "ymin")


@query("primary_box", f"SELECT {_ROW_SQL} FROM {_BOXES_SQL} WHERE l_partkey BETWEEN 10 AND 90 AND {_Q_SQL}")
def _(spark, d):
    return _boxes(spark, d).where(F.col("l_partkey").between(10, 90) & g.intersects(BOX, _Q)).select(*_ROW)


def _query_boxes(spark):
    return spark.range(16).select(F.col("id").alias("qid"), (F.col("id") * 3).cast("double").alias("x0"), (F.col("id") * 3 + 4).cast("double").alias("x1"), F.lit(0.02).alias("y0"), F.lit(0.06).alias("y1"))


_JOIN_SQL = f"SELECT qid, count(*) AS hits FROM (SELECT range AS qid, range * 3.0 AS x0, range * 3.0 + 4 AS x1 FROM range(16)) q JOIN {_BOXES_SQL} b ON xmax >= x0 AND xmin <= x1 AND ymax >= 0.02 AND ymin <= 0.06 GROUP BY qid"


@query("box_query_set_join", _JOIN_SQL)
def _(spark, d):
    return secondary.box_join(_boxes(spark, d), _query_boxes(spark), BOX, "l_orderkey").groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))


@query("box_query_set_grid_join", _JOIN_SQL)
def _(spark, d):
    return secondary.box_join(_boxes(spark, d), _query_boxes(spark), BOX, "l_orderkey", cell=5.0).groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))


@query("mbr_union_by_group", f"SELECT l_returnflag, min(xmin) AS x0, max(xmax) AS x1, min(ymin) + 0.0 AS y0, max(ymax) AS y1 FROM {_BOXES_SQL} GROUP BY 1")
def _(spark, d):
    return _boxes(spark, d).groupBy("l_returnflag").agg(F.min("xmin").alias("x0"), F.max("xmax").alias("x1"), (F.min("ymin") + 0.0).alias("y0"), F.max("ymax").alias("y1"))


@query("box_overlap_area", f"SELECT {_ROW_SQL}, round(CASE WHEN least(xmax, 20) > greatest(xmin, 15) AND least(ymax, 0.05) > greatest(ymin, 0.03) THEN (least(xmax, 20) - greatest(xmin, 15)) * (least(ymax, 0.05) - greatest(ymin, 0.03)) ELSE 0 END, 6) AS overlap, round((xmax - xmin) * (ymax - ymin), 6) AS area FROM {_BOXES_SQL}")
def _(spark, d):
    own = tuple(map(F.col, BOX))
    return _boxes(spark, d).select(*_ROW, F.round(g.overlap_area(own, tuple(map(F.lit, _Q))), 6).alias("overlap"), F.round(g.area(*own), 6).alias("area"))


_CELL_SQL = "CAST(greatest(0, least(15, floor(((xmin + xmax) / 2 - 0) / 52 * 16))) AS BIGINT) AS cx, CAST(greatest(0, least(15, floor(((ymin + ymax) / 2 - 0) / 0.2 * 16))) AS BIGINT) AS cy"


def _sketch(spark, d, where=None):
    cx = g.cell((F.col("xmin") + F.col("xmax")) / 2, 0, 52, 16)
    cy = g.cell((F.col("ymin") + F.col("ymax")) / 2, 0, 0.2, 16)
    rows = _boxes(spark, d)
    return (rows if where is None else rows.where(where)).groupBy(cx.alias("cx"), cy.alias("cy")).agg(F.count(F.lit(1)).alias("n"))


@query("sketch16", f"SELECT cx, cy, count(*) AS n FROM (SELECT {_CELL_SQL} FROM {_BOXES_SQL}) GROUP BY 1, 2")
def _(spark, d):
    return _sketch(spark, d)


@query("sketch_extent", f"SELECT min(cx) AS x0, max(cx) AS x1, min(cy) AS y0, max(cy) AS y1, count(*) AS total FROM (SELECT {_CELL_SQL} FROM {_BOXES_SQL})")
def _(spark, d):
    return _sketch(spark, d).agg(F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1"), F.sum("n").alias("total"))


_Z_SQL = " | ".join(f"(((x >> {i}) & 1) << {2 * i + 1}) | (((y >> {i}) & 1) << {2 * i})" for i in range(8))


@query("zorder_value", f"SELECT l_orderkey, l_partkey, {_Z_SQL} AS z FROM (SELECT l_orderkey, l_partkey, CAST(l_orderkey % 256 AS BIGINT) AS x, CAST(l_partkey % 256 AS BIGINT) AS y FROM lineitem)")
def _(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", g.z_value(F.col("l_orderkey") % 256, F.col("l_partkey") % 256, 8).alias("z"))


def _hilbert_sql(bits: int) -> str:
    """The distance along the curve, one level after the other from the coarsest: x, y as they are turned, and the sum so far."""
    level = "SELECT l_orderkey, l_partkey, CAST(l_orderkey % {n} AS BIGINT) AS x, CAST(l_partkey % {n} AS BIGINT) AS y, CAST(0 AS BIGINT) AS h FROM lineitem".format(n=1 << bits)
    for k in reversed(range(bits)):
        s = 1 << k
        rx, ry = f"((x >> {k}) & 1)", f"((y >> {k}) & 1)"
        turned = lambda a, b, s=s, rx=rx, ry=ry: f"CASE WHEN {ry} = 1 THEN {a} WHEN {rx} = 1 THEN {s - 1} - ({b} & {s - 1}) ELSE {b} END"
        level = f"SELECT l_orderkey, l_partkey, {turned('x', 'y')} AS x, {turned('y', 'x')} AS y, h + {s * s} * xor(3 * {rx}, {ry}) AS h FROM ({level})"
    return f"SELECT l_orderkey, l_partkey, h FROM ({level})"


@query("hilbert_value", _hilbert_sql(8))
def _(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", g.hilbert_udf(8)(F.col("l_orderkey") % 256, F.col("l_partkey") % 256).alias("h"))


@query("range_center_sort", "SELECT event_id, (value + value + 10) / 2 AS center FROM events ORDER BY center, event_id")
def _(spark, d):
    return _events(spark, d).select("event_id", ((F.col("value") + F.col("value") + 10) / 2).alias("center")).orderBy("center", "event_id")


# --- folds

_CENTS = Log(key=("user_id",), seq="event_id", value=("cents",))


def _cents(spark, d):
    return _ops(spark, d).select("user_id", "event_id", "cents")


for _name, _sql in (("sum", "sum(cents)"), ("max", "max(cents)"), ("xor", "bit_xor(cents)")):

    @query(f"merge_{_name}", f"SELECT user_id, CAST({_sql} AS BIGINT) AS value FROM {_OPS_SQL} GROUP BY 1")
    def _(spark, d, name=_name):
        return merge.fold_fast(_cents(spark, d), _CENTS, name)


@query("merge_put", f"SELECT user_id, cents AS value FROM {_newest('user_id', table=_OPS_SQL)}")
def _(spark, d):
    return merge.fold(_cents(spark, d), _CENTS, "put")


@query("merge_append", "SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS value FROM events GROUP BY 1")
def _(spark, d):
    return merge.fold(_events(spark, d), Log(key=("user_id",), seq="event_id", value=("event_type",)), "append")


@query("merge_sortlist", f"SELECT user_id, array_to_string(list_sort(list(CAST(cents AS INTEGER))), ',') AS value FROM {_OPS_SQL} GROUP BY 1")
def _(spark, d):
    rows = _cents(spark, d).withColumn("cents", F.col("cents").cast("string"))
    return merge.fold(rows, _CENTS, "sortlist").withColumn("value", F.array_join("value", ","))


@query("merge_mul_sign", "SELECT user_id, CAST(product(1 - 2 * (event_id % 2)) AS BIGINT) AS value FROM events GROUP BY 1")
def _(spark, d):
    rows = _events(spark, d).select("user_id", "event_id", (1 - 2 * (F.col("event_id") % 2)).alias("cents"))
    return merge.fold(rows, _CENTS, "mul")


@query("merge_last3", "SELECT user_id, array_to_string(list(event_type ORDER BY event_id DESC)[1:3], ',') AS value FROM events GROUP BY 1")
def _(spark, d):
    out = merge.fold(_events(spark, d), Log(key=("user_id",), seq="event_id", value=("event_type",)), "last3")
    return out.withColumn("value", F.array_join("value", ","))


@query(
    "merge_over_put_delete",
    f"""SELECT user_id, CAST(sum(cents) AS BIGINT) AS value FROM (
          SELECT *, max(CASE WHEN op <> 'merge' THEN event_id END) OVER (PARTITION BY user_id) AS b FROM {_OPS_SQL}) t
        WHERE (b IS NULL OR event_id >= b) AND op <> 'delete' GROUP BY 1""",
)
def _(spark, d):
    return merge.fold(_ops(spark, d), OPS, "sum")


@query("merge_operands", "SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS operands, CASE WHEN count(*) > 60 THEN 'incomplete' ELSE 'ok' END AS status FROM events GROUP BY 1")
def _(spark, d):
    out = merge.operands(_events(spark, d), Log(key=("user_id",), seq="event_id", value=("event_type",)), 60)
    return out.withColumn("operands", F.array_join("operands", ","))


_AGG = "list(struct_pack(f := CASE op WHEN 'put' THEN 'max' ELSE 'sum' END, v := cents) ORDER BY event_id)"


@query("agg_merge", f"SELECT user_id, list_reduce({_AGG}, lambda a, x: struct_pack(f := x.f, v := CASE x.f WHEN 'sum' THEN a.v + x.v ELSE greatest(a.v, x.v) END)).v AS value, 'ok' AS status FROM {_OPS_SQL} GROUP BY 1")
def _(spark, d):
    rows = _ops(spark, d).withColumn("f", F.when(F.col("op") == "put", "max").otherwise("sum"))
    return merge.agg_merge(rows, OPS, "f", "cents").select("user_id", "value", "status")


# --- tombstones, compaction, eviction

_TOMBS = "(VALUES (CAST(2 AS BIGINT), CAST(6 AS BIGINT), CAST(400 AS BIGINT)), (4, 9, 800), (12, 13, 100))"


def _tombs(spark):
    return spark.sql(f"SELECT * FROM {_TOMBS} AS t(`begin`, `end`, seq)".replace("AS BIGINT", "AS LONG"))


_LIVE = f"NOT EXISTS (SELECT 1 FROM {_TOMBS} t(b, e, s) WHERE user_id >= b AND user_id < e AND s > event_id)"


@query("range_delete", f"SELECT event_id, user_id FROM events WHERE {_LIVE}")
def _(spark, d):
    return ranges.apply_tombstones(_events(spark, d), _tombs(spark), EVENTS).select("event_id", "user_id")


@query("tombstone_fragments", "SELECT * FROM (VALUES (CAST(2 AS BIGINT), CAST(4 AS BIGINT), CAST(400 AS BIGINT)), (4, 6, 800), (6, 9, 800), (12, 13, 100)) t(\"begin\", \"end\", seq)")
def _(spark, d):
    return ranges.fragments(_tombs(spark))


@query("ttl_live", "SELECT event_id FROM events WHERE NOT (event_id % 7 > 0 AND event_id + 50 * (event_id % 7) < 900)")
def _(spark, d):
    ttl = 50 * (F.col("event_id") % 7)
    return _events(spark, d).where(~compact.expired(F.col("event_id"), ttl, F.lit(900))).select("event_id")


@query("remove_empty", "SELECT doc_id FROM documents WHERE length(text) > 0")
def _(spark, d):
    return _t(spark, d, "documents").where(F.octet_length("text") > 0).select("doc_id")


@query(
    "compaction",
    f"""WITH k AS (SELECT * FROM (SELECT *, max(CASE WHEN op <> 'merge' THEN event_id END) OVER (PARTITION BY user_id) AS b, max(event_id) OVER (PARTITION BY user_id) AS top FROM {_OPS_SQL} WHERE {_LIVE}) WHERE b IS NULL OR event_id >= b)
        SELECT user_id, event_id, op, cents FROM k WHERE op <> 'delete' AND NOT (op = 'put' AND event_id = top AND cents < 100)""",
)
def _(spark, d):
    return compact.compact(_ops(spark, d), OPS, drop=F.col("cents") < 100, tombstones=_tombs(spark)).select("user_id", "event_id", "op", "cents")


@query("fifo_evict", "SELECT l_orderkey, running FROM (SELECT l_orderkey, sum(n) OVER (ORDER BY l_orderkey DESC) AS running FROM (SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY 1)) WHERE running <= 5000")
def _(spark, d):
    files = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("n"))
    return compact.evict_oldest(files, "n", "l_orderkey", 5000).select("l_orderkey", "running")


@query(
    "snapshot_stripes",
    """SELECT user_id, stripe, event_id FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id, stripe ORDER BY event_id DESC) rn FROM (
           SELECT *, CASE WHEN event_id <= 200 THEN 200 WHEN event_id <= 700 THEN 700 END AS stripe FROM events)) WHERE rn = 1""",
)
def _(spark, d):
    return resolve.stripes(_events(spark, d), EVENTS, [200, 700]).select("user_id", "stripe", "event_id")


_SD = Log(key=("user_id",), seq="event_id", op="op")
_SD_SQL = "(SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'single_delete' ELSE 'put' END AS op FROM events)"


def _sd(spark, d):
    return _events(spark, d).select("user_id", "event_id", F.when(F.col("event_type") == "error", "single_delete").otherwise("put").alias("op"))


@query(
    "single_delete_cancel",
    f"""SELECT user_id, event_id, op FROM (
          SELECT *, lead(op) OVER w AS nx, lag(op) OVER w AS pv FROM {_SD_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) t
        WHERE NOT (op = 'put' AND coalesce(nx, '') = 'single_delete') AND NOT (op = 'single_delete' AND coalesce(pv, '') = 'put')""",
)
def _(spark, d):
    return resolve.cancel_single_deletes(_sd(spark, d), _SD)


@query(
    "single_delete_contract",
    f"""SELECT user_id, CAST(puts AS BIGINT) AS puts FROM (
          SELECT user_id, ep, sum(CAST(op = 'put' AS INT)) AS puts, max(CAST(op <> 'put' AS INT)) AS sd FROM (
            SELECT *, coalesce(max(CASE WHEN op <> 'put' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS ep FROM {_SD_SQL})
          GROUP BY 1, 2) WHERE puts > 1 AND sd = 1""",
)
def _(spark, d):
    return resolve.single_delete_violations(_sd(spark, d), _SD)


@query("deletion_trigger", "SELECT user_id, max(c) AS most_deletes, max(c) >= 4 AS flagged FROM (SELECT user_id, CAST(sum(CAST(event_type = 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS BIGINT) AS c FROM events) GROUP BY 1")
def _(spark, d):
    return resolve.deletion_trigger(_events(spark, d), "user_id", "event_id", F.col("event_type") == "error", 10, 4)


# --- wide columns


@query("wide_row_merge", f"SELECT user_id, event_type, event_id, value FROM {_newest('user_id, event_type')} n WHERE event_id > coalesce((SELECT max(event_id) FROM events t WHERE t.user_id = n.user_id AND t.event_type = 'error'), -1)")
def _(spark, d):
    e = _events(spark, d)
    tombs = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("row_ts"))
    return wide.merge_rows(e, "user_id", "event_type", "event_id", ["value"], tombs)


@query("wide_latest_column", f"SELECT user_id, value AS click FROM {_newest('user_id, event_type')} WHERE event_type = 'click'")
def _(spark, d):
    rows = wide.merge_rows(_events(spark, d), "user_id", "event_type", "event_id", ["value"])
    maps = rows.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "value"))).alias("columns"))
    return maps.select("user_id", wide.column(F.col("columns"), "click").alias("click")).where(F.col("click").isNotNull())


@query("wide_default_column", "SELECT o_orderkey, o_orderstatus AS value FROM orders")
def _(spark, d):
    e = _t(spark, d, "orders").select("o_orderkey", wide.entity(F.col("o_orderstatus")).alias("columns"))
    return e.select("o_orderkey", wide.column(F.col("columns"), "").alias("value"))


@query(
    "wide_expire",
    "SELECT user_id, sum(CAST(event_id + 100 < 700 AND event_type = 'view' AS INT)) AS tombstones, count(*) AS n FROM events GROUP BY 1",
)
def _(spark, d):
    c = F.struct(F.when(F.col("event_type") == "view", "expiring").otherwise("column").alias("kind"), F.col("event_type").alias("idx"), F.col("event_id").alias("ts"), F.col("value"), F.lit(100).alias("ttl"))
    rows = _events(spark, d).groupBy("user_id").agg(F.collect_list(c).alias("columns")).select("user_id", wide.expire(F.col("columns"), F.lit(700)).alias("columns"))
    return rows.select("user_id", F.size(F.filter("columns", lambda x: x["kind"] == "tombstone")).cast("long").alias("tombstones"), F.size("columns").cast("long").alias("n"))


# --- batches


@query("overlay_base_delta", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 10 <> 2")
def _(spark, d):
    base = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    delta = base.where("o_orderkey % 10 IN (1, 2)").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 10 == 2, "delete").otherwise("put").alias("op"))
    return overlay.overlay(base, delta, "o_orderkey")


@query("txn_conflicts", f"SELECT DISTINCT user_id FROM events WHERE event_id < 50 AND user_id IN (SELECT user_id FROM events WHERE event_id > {SNAPSHOT})")
def _(spark, d):
    e = _events(spark, d)
    return overlay.conflicts(e.where("event_id < 50").select("user_id").distinct(), e, EVENTS, SNAPSHOT)


@query("ingest_newest", "SELECT user_id, event_id, cents FROM (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS cents, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) rn FROM events WHERE user_id > 5) WHERE rn = 1 UNION ALL SELECT user_id, (SELECT max(event_id) + 1 FROM events), CAST(0 AS BIGINT) FROM (SELECT DISTINCT user_id FROM events WHERE user_id <= 5)")
def _(spark, d):
    log = _cents(spark, d)
    external = log.where("user_id <= 5").select("user_id", F.lit(0).cast("long").alias("cents")).distinct()
    return resolve.latest(overlay.ingest(log, external, "event_id"), _CENTS)


@query("changes_since", "SELECT event_id, user_id, event_type FROM events WHERE event_id >= 700")
def _(spark, d):
    return overlay.changes_since(_events(spark, d), "event_id", 700).select("event_id", "user_id", "event_type")


@query("batch_write", "SELECT user_id, CAST(1000000 - 1 + row_number() OVER (ORDER BY event_id) AS BIGINT) AS seq FROM events")
def _(spark, d):
    return overlay.sequenced(_events(spark, d), "event_id", 1_000_000).select("user_id", "seq")


@query("batch_counts", f"SELECT op, count(*) AS n FROM {_OPS_SQL} GROUP BY 1")
def _(spark, d):
    return overlay.batch_counts(_ops(spark, d), "op")


@query("approximate_sizes", "SELECT CAST(user_id // 5 AS BIGINT) AS bucket, count(*) AS keys, CAST(sum(length(props)) AS BIGINT) AS bytes FROM events GROUP BY 1")
def _(spark, d):
    return _events(spark, d).groupBy(F.floor(F.col("user_id") / 5).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("keys"), F.sum(F.length("props")).alias("bytes"))


@query("table_properties", f"SELECT op, count(*) AS entries, count(DISTINCT user_id) AS keys, CAST(sum(length(CAST(cents AS VARCHAR))) AS BIGINT) AS bytes FROM {_OPS_SQL} GROUP BY 1")
def _(spark, d):
    return _ops(spark, d).groupBy("op").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("user_id").alias("keys"), F.sum(F.length(F.col("cents").cast("string"))).alias("bytes"))


# --- traces

_OK_SQL = "CAST(length(props) > 9 AS DOUBLE)"


@query("trace_totals", f"SELECT event_type, count(*) AS accesses, count(DISTINCT user_id) AS keys, round(avg({_OK_SQL}), 8) AS success FROM events GROUP BY 1")
def _(spark, d):
    return trace.totals(_events(spark, d), "event_type", "user_id", F.length("props") > 9).withColumn("success", F.round("success", 8))


@query("trace_key_stats", "SELECT user_id, count(*) AS accesses, row_number() OVER (ORDER BY user_id) - 1 AS key_id FROM events GROUP BY 1")
def _(spark, d):
    return trace.key_stats(_events(spark, d), "user_id")


@query("trace_count_dist", "SELECT accesses, count(*) AS keys FROM (SELECT count(*) AS accesses FROM events GROUP BY user_id) GROUP BY 1")
def _(spark, d):
    return trace.count_distribution(_events(spark, d), "user_id")


@query("trace_key_size_dist", "SELECT length(CAST(user_id AS VARCHAR)) AS size, count(DISTINCT user_id) AS keys FROM events GROUP BY 1")
def _(spark, d):
    return trace.key_size_distribution(_events(spark, d), "user_id")


@query("trace_value_dist", "SELECT CAST(length(props) // 8 AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return trace.value_size_distribution(_events(spark, d), F.length("props"))


_RATE_SQL = "SELECT \"at\", coalesce(n, 0) AS n FROM (SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts)) FROM events), (SELECT date_trunc('hour', max(ts)) FROM events), INTERVAL 1 HOUR)) AS \"at\") s LEFT JOIN (SELECT date_trunc('hour', ts) AS \"at\", count(*) AS n FROM events GROUP BY 1) USING (\"at\")"


@query("trace_qps", _RATE_SQL)
def _(spark, d):
    return trace.rate(_events(spark, d), "ts")


@query("trace_topk_qps", f"{_RATE_SQL} ORDER BY n DESC, \"at\" LIMIT 5")
def _(spark, d):
    return trace.top_rates(_events(spark, d), "ts", 5)


@query("trace_topk_keys", "SELECT user_id, count(*) AS accesses FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(spark, d):
    return trace.top_keys(_events(spark, d), "user_id", 5)


@query("trace_prefix_cut", f"SELECT substr(CAST(user_id AS VARCHAR), 1, 1) AS prefix, count(*) AS accesses, count(DISTINCT user_id) AS keys, round(avg({_OK_SQL}), 8) AS success, round(count(*) / count(DISTINCT user_id), 6) AS mean FROM events GROUP BY 1")
def _(spark, d):
    return trace.prefix_cut(_events(spark, d), "user_id", 1, F.length("props") > 9).withColumns({"success": F.round("success", 8), "mean": F.round("mean", 6)})


@query("trace_correlation", "SELECT count(*) AS n, round(avg(event_id - a), 6) AS mean_gap FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM events) WHERE event_type = 'purchase' AND a IS NOT NULL")
def _(spark, d):
    return trace.pair_correlation(_events(spark, d), "user_id", "event_id", "event_type", "view", "purchase").withColumn("mean_gap", F.round("mean_gap", 6))


@query("trace_coverage", "SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def _(spark, d):
    return trace.coverage(_t(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), _events(spark, d), "user_id")


@query("trace_time_series", "SELECT event_type, date_trunc('hour', ts) AS at, dense_rank() OVER (ORDER BY user_id) - 1 AS key_id, event_id FROM events")
def _(spark, d):
    e = _events(spark, d)
    ids = trace.key_stats(e, "user_id").select("user_id", "key_id")
    return e.join(ids, "user_id").select("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("at"), "key_id", "event_id")


@query("trace_unique_over_time", "SELECT \"at\", CAST(sum(n) OVER (ORDER BY \"at\") AS BIGINT) AS keys, round(sum(n) OVER (ORDER BY \"at\") / sum(n) OVER (), 8) AS share FROM (SELECT \"at\", coalesce(n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(f) FROM (SELECT date_trunc('hour', min(ts)) AS f FROM events GROUP BY user_id)), (SELECT max(f) FROM (SELECT date_trunc('hour', min(ts)) AS f FROM events GROUP BY user_id)), INTERVAL 1 HOUR)) AS \"at\") LEFT JOIN (SELECT f AS \"at\", count(*) AS n FROM (SELECT date_trunc('hour', min(ts)) AS f FROM events GROUP BY user_id) GROUP BY 1) USING (\"at\"))")
def _(spark, d):
    return trace.unique_over_time(_events(spark, d), "user_id", "ts").withColumn("share", F.round("share", 8))


@query("hist_summary", "SELECT event_type, count(value) AS n, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def _(spark, d):
    return trace.histogram(_events(spark, d), "value", "event_type").withColumns({c: F.round(c, 6) for c in ("mean", "sd", "p50", "p95", "p99")})


@query("hist_windowed", "SELECT date_trunc('day', ts) AS at, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50 FROM events GROUP BY 1")
def _(spark, d):
    e = _events(spark, d).withColumn("at", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return trace.histogram(e, "value", "at").select("at", "n", F.round("p50", 6).alias("p50"))


@query("reuse_interval", "SELECT CAST(gap // 3600 AS BIGINT) AS bucket, count(*) AS n FROM (SELECT CAST(floor(epoch(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) AS BIGINT) AS gap FROM events) WHERE gap IS NOT NULL GROUP BY 1")
def _(spark, d):
    return trace.reuse_interval(_events(spark, d), "user_id", "ts", 3600)


@query("reuse_lifetime", "SELECT user_id, CASE WHEN count(*) > 1 THEN CAST(floor(epoch(max(ts) - min(ts))) AS BIGINT) END AS lifetime FROM events GROUP BY 1")
def _(spark, d):
    return trace.lifetime(_events(spark, d), "user_id", "ts")


@query("access_skew", "SELECT p AS percent, round(sum(n) / max(total), 8) AS share FROM (SELECT *, CASE WHEN r <= floor(labels * 10 / 100) THEN 10 WHEN r <= floor(labels * 50 / 100) THEN 50 WHEN r <= labels THEN 100 END AS p FROM (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id) AS r, count(*) OVER () AS labels, sum(count(*)) OVER () AS total FROM events GROUP BY user_id)) GROUP BY 1")
def _(spark, d):
    return trace.skew(_events(spark, d), "user_id", (10, 50, 100)).withColumn("share", F.round("share", 8))


@query("timeline_by_label", "SELECT date_trunc('day', ts) AS at, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return trace.timeline(_events(spark, d), "ts", "event_type")


@query("percent_by_label", "SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM events GROUP BY 1")
def _(spark, d):
    return trace.percent_by(_events(spark, d), "event_type").withColumn("percent", F.round("percent", 6))


@query("spatial_locality", "SELECT CAST(l_partkey // 16 AS BIGINT) AS block, round(count(DISTINCT l_partkey) / 16.0, 6) AS referenced FROM lineitem GROUP BY 1")
def _(spark, d):
    return _t(spark, d, "lineitem").groupBy(F.floor(F.col("l_partkey") / 16).cast("long").alias("block")).agg(F.round(F.countDistinct("l_partkey") / 16.0, 6).alias("referenced"))


def _blocks(spark, d):
    return _events(spark, d).withColumn("size", F.length("props"))


for _policy in ("lru", "mru", "lfu", "fifo", "opt"):

    @query(f"{_policy}_misses")
    def _(spark, d, policy=_policy):
        return cachesim.simulate(_blocks(spark, d), "user_id", "size", "event_id", [128, 512, 2048], policy)


@query(
    "reuse_distance",
    """WITH a AS (SELECT event_type AS label, event_id AS at, length(props) AS s, lag(event_id) OVER w AS prev, lead(event_id) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY event_id))
       SELECT i.label, i.at, CAST(CASE WHEN any_value(i.prev) IS NOT NULL THEN coalesce(sum(k.s), 0) END AS BIGINT) AS distance
       FROM a i LEFT JOIN a k ON k.label = i.label AND k.at > i.prev AND k.at < i.at AND (k.nxt IS NULL OR k.nxt > i.at) GROUP BY 1, 2""",
)
def _(spark, d):
    return cachesim.reuse_distances(_blocks(spark, d), "user_id", "size", "event_id", "event_type")
