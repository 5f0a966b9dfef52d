"""Queries over operation traces, block traces, statistics and caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvlog.operators import advisor, cachesim, grouping, resolve, trace
from kvlog.plans.catalog import _CELL_SQL, _BOXES_SQL, _boxes, _events, _sketch, query

_SIZE = "length(props)"


def _hist_sql(source: str, by: str, value: str) -> str:
    """The bucket histogram over rows of ``source``, a table with columns ``by`` and ``value``."""
    limits = trace.bucket_limits()
    ends = ", ".join(map(str, limits))
    p = lambda q: f"""(SELECT round(least(greatest(arg_min(low + (high - low) * (want - cum + n) / n, b), min(lo)), min(hi)), 6) FROM
        (SELECT c.b, c.n, c.cum, t.lo, t.hi, t.total * {q} / 100.0 AS want, CASE WHEN c.b = 0 THEN 0 ELSE ends[c.b] END AS low, ends[c.b + 1] AS high FROM c, lim WHERE c.{by} = t.{by}) x WHERE cum >= want) AS p{q:g}"""  # noqa: E731
    return f"""WITH lim AS (SELECT CAST([{ends}] AS BIGINT[]) AS ends),
v AS (SELECT {by}, CAST({value} AS BIGINT) AS v FROM {source} WHERE {value} IS NOT NULL),
bc AS (SELECT {by}, len(list_filter(ends[1:len(ends) - 1], lambda e: e < v)) AS b, count(*) AS n FROM v, lim GROUP BY 1, 2),
c AS (SELECT {by}, b, n, sum(n) OVER (PARTITION BY {by} ORDER BY b) AS cum FROM bc),
t AS (SELECT {by}, count(*) AS total, min(v) AS lo, max(v) AS hi, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM v GROUP BY 1)
SELECT {by}, total AS n, lo, hi, mean, sd, {p(50)}, {p(95)}, {p(99)} FROM t"""


_ROUNDED = ("mean", "sd", "p50", "p95", "p99")


@query("hist_buckets", _hist_sql("(SELECT event_type, round(value * 100) AS v0 FROM events)", "event_type", "v0"))
def _(spark, d):
    rows = _events(spark, d).select("event_type", F.round(F.col("value") * 100).cast("long").alias("v0"))
    return trace.bucket_histogram(rows, "v0", "event_type").withColumns({c: F.round(c, 6) for c in _ROUNDED})


@query("hist_buckets_windowed", _hist_sql("(SELECT date_trunc('day', ts) AS \"at\", event_id FROM events)", '"at"', "event_id"))
def _(spark, d):
    rows = _events(spark, d).select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("at"), "event_id")
    return trace.bucket_histogram(rows, "event_id", "at").withColumns({c: F.round(c, 6) for c in _ROUNDED})


@query("tickers", f"SELECT event_type AS ticker, \"at\", CAST(s AS BIGINT) AS delta, CAST(sum(s) OVER (PARTITION BY event_type ORDER BY \"at\") AS BIGINT) AS total FROM (SELECT event_type, date_trunc('hour', ts) AS \"at\", sum({_SIZE}) AS s FROM events GROUP BY 1, 2)")
def _(spark, d):
    return trace.tickers(_events(spark, d), "ts", "event_type", F.length("props"))


@query("ticker_deltas", f"SELECT event_type AS ticker, \"at\", CAST(s AS BIGINT) AS delta FROM (SELECT event_type, date_trunc('hour', ts) AS \"at\", sum({_SIZE}) AS s FROM events GROUP BY 1, 2)")
def _(spark, d):
    return trace.ticker_deltas(trace.tickers(_events(spark, d), "ts", "event_type", F.length("props")).select("ticker", "at", "total")).select("ticker", "at", "delta")


@query("trace_rate_summary", "SELECT count(*) AS n, round(count(*) / epoch(max(ts) - min(ts))::BIGINT, 8) AS average, (SELECT max(c) FROM (SELECT count(*) AS c FROM events GROUP BY date_trunc('second', ts))) AS peak FROM events")
def _(spark, d):
    return trace.rate_summary(_events(spark, d), "ts").withColumn("average", F.round("average", 8))


@query("trace_topk_qps_prefixes", "SELECT date_trunc('hour', ts) AS at, substr(CAST(user_id AS VARCHAR), 1, 1) AS prefix, count(*) AS accesses FROM events WHERE date_trunc('hour', ts) IN (SELECT h FROM (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, h LIMIT 5)) GROUP BY 1, 2")
def _(spark, d):
    return trace.top_rate_prefixes(_events(spark, d), "ts", "user_id", 1, 5)


_KINDS = ["click", "error", "purchase", "signup", "view"]


@query(
    "trace_correlation_matrix",
    "SELECT first, event_type AS second, count(*) AS n, round(avg(event_id - was), 6) AS mean_gap FROM (SELECT *, last_value(CASE WHEN event_type = first THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, first ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM events, (SELECT DISTINCT event_type AS first FROM events)) WHERE was IS NOT NULL GROUP BY 1, 2",
)
def _(spark, d):
    return trace.correlation_matrix(_events(spark, d), "user_id", "event_id", "event_type", _KINDS).withColumn("mean_gap", F.round("mean_gap", 6))


@query("trace_sample", "SELECT event_id, user_id FROM events WHERE CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 12) AS BIGINT) % 1000000 < 250000")
def _(spark, d):
    return trace.sample(_events(spark, d), "user_id", 0.25).select("event_id", "user_id")


@query("trace_readable", "SELECT event_type || ' ' || hex(CAST(user_id AS VARCHAR)) || ' ' || length(props) || ' ' || epoch_us(ts) AS line FROM events")
def _(spark, d):
    return trace.readable(_events(spark, d), "ts", "event_type", "user_id", F.length("props"))


@query("miss_timeline", "SELECT date_trunc('hour', ts) AS at, count(*) AS accesses, CAST(sum(CAST(value >= 50 AS INT)) AS BIGINT) AS misses, round(sum(CAST(value >= 50 AS INT)) / count(*), 8) AS ratio FROM events GROUP BY 1")
def _(spark, d):
    return trace.miss_timeline(_events(spark, d), "ts", F.col("value") < 50).withColumn("ratio", F.round("ratio", 8))


#: The least recently used block of a constant size is held as long as the bytes of distinct blocks since its last access, and
#: its own, fit: the recency list's held blocks are the longest prefix that fits.
_STACK = """
a AS (SELECT event_id, user_id AS b, 8 + user_id % 9 AS s, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events),
dist AS (SELECT i.event_id, i.s, any_value(i.prev) AS prev, coalesce(sum(k.s), 0) AS between_ FROM a i LEFT JOIN a k ON k.event_id > i.prev AND k.event_id < i.event_id AND (k.nxt IS NULL OR k.nxt > i.event_id) GROUP BY 1, 2)"""
_CAPACITIES = [128, 512, 1024]


def _fixed_blocks(spark, d):
    return _events(spark, d).withColumn("size", 8 + F.col("user_id") % 9)


@query("miss_ratio_curve", f"WITH {_STACK} SELECT capacity, count(*) AS accesses, CAST(sum(CAST(prev IS NULL OR between_ + s > capacity AS INT)) AS BIGINT) AS misses, round(sum(CAST(prev IS NULL OR between_ + s > capacity AS INT)) / count(*), 8) AS miss_ratio FROM dist, (SELECT unnest({_CAPACITIES})::BIGINT AS capacity) GROUP BY 1")
def _(spark, d):
    return cachesim.simulate(_fixed_blocks(spark, d), "user_id", "size", "event_id", _CAPACITIES, "lru").withColumn("miss_ratio", F.round("miss_ratio", 8))


@query("simulated_miss_timeline", f"WITH {_STACK} SELECT capacity, event_id // 1000 AS step, count(*) AS accesses, CAST(sum(CAST(prev IS NULL OR between_ + s > capacity AS INT)) AS BIGINT) AS misses FROM dist, (SELECT unnest({_CAPACITIES})::BIGINT AS capacity) GROUP BY 1, 2")
def _(spark, d):
    return cachesim.replay(_fixed_blocks(spark, d), "user_id", "size", "event_id", _CAPACITIES, "lru", every=1000)


for _policy in ("hyperbolic", "cost_class", "gdsize", "arc", "thompson", "linucb", "prioritized", "ghost"):

    @query(f"{_policy}_misses")
    def _(spark, d, policy=_policy):
        return cachesim.simulate(_events(spark, d).withColumn("size", F.length("props")), "user_id", "size", "event_id", [128, 512, 2048], policy, label="event_type")


@query("access_features", "SELECT user_id, event_id, CAST(floor(epoch(ts - lag(ts) OVER w)) AS BIGINT) AS since_last, row_number() OVER w - 1 AS accesses_before, CAST(floor(epoch(lead(ts) OVER w - ts)) AS BIGINT) AS to_next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def _(spark, d):
    return trace.access_features(_events(spark, d), "user_id", "ts", "event_id")


@query("feature_correlation", "WITH f AS (SELECT CAST(floor(epoch(ts - lag(ts) OVER w)) AS BIGINT) AS since_last, row_number() OVER w - 1 AS accesses_before, CAST(floor(epoch(lead(ts) OVER w - ts)) AS BIGINT) AS to_next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT 'since_last' AS feature, count(*) AS n, round(corr(since_last, to_next), 6) AS correlation FROM f WHERE since_last IS NOT NULL AND to_next IS NOT NULL UNION ALL SELECT 'accesses_before', count(*), round(corr(accesses_before, to_next), 6) FROM f WHERE to_next IS NOT NULL")
def _(spark, d):
    f = trace.access_features(_events(spark, d), "user_id", "ts", "event_id")
    return trace.feature_correlation(f, "to_next", "since_last", "accesses_before").withColumn("correlation", F.round("correlation", 6))


@query("reuse_timeline", "WITH p AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS \"at\" FROM events), f AS (SELECT user_id, min(\"at\") AS first FROM p GROUP BY 1) SELECT first, CAST(epoch(\"at\" - first) // 3600 AS BIGINT) AS later, count(*) AS blocks FROM p JOIN f USING (user_id) GROUP BY 1, 2")
def _(spark, d):
    return trace.reuse_timeline(_events(spark, d), "user_id", "ts")


@query("block_stats", f"SELECT event_type, a.n AS blocks, a.lo AS accesses_lo, a.hi AS accesses_hi, a.mean AS accesses_mean, a.p50 AS accesses_p50, b.hi AS bytes_hi, b.p95 AS bytes_p95 FROM ({_hist_sql('(SELECT event_type, user_id, count(*) AS acc FROM events GROUP BY 1, 2)', 'event_type', 'acc')}) a JOIN ({_hist_sql(f'(SELECT event_type, user_id, max({_SIZE}) AS byt FROM events GROUP BY 1, 2)', 'event_type', 'byt')}) b USING (event_type)")
def _(spark, d):
    out = trace.block_stats(_events(spark, d).withColumn("size", F.length("props")), "user_id", "size", "event_type")
    return out.select("event_type", "blocks", "accesses_lo", "accesses_hi", *[F.round(c, 6).alias(c) for c in ("accesses_mean", "accesses_p50")], "bytes_hi", F.round("bytes_p95", 6).alias("bytes_p95"))


@query("io_summary", f"SELECT event_type, files, bytes, h.n, h.mean, h.p99 FROM ({_hist_sql('(SELECT event_type, round(value * 100) AS v0 FROM events)', 'event_type', 'v0')}) h JOIN (SELECT event_type, count(DISTINCT user_id) AS files, CAST(sum({_SIZE}) AS BIGINT) AS bytes FROM events GROUP BY 1) USING (event_type)")
def _(spark, d):
    rows = _events(spark, d).select("event_type", "user_id", F.round(F.col("value") * 100).cast("long").alias("v0"), F.length("props").alias("size"))
    out = trace.io_summary(rows, "event_type", "user_id", "v0", "size")
    return out.select("event_type", "files", "bytes", "n", F.round("mean", 6).alias("mean"), F.round("p99", 6).alias("p99"))


_RULES = [advisor.Rule("hot errors", ("errors", "bursts"), "raise the retry delay"), advisor.Rule("many sevens", ("sevens",), "widen the key"), advisor.Rule("never", ("none",), "-")]


@query("advisor", "SELECT 'many sevens' AS rule, 'widen the key' AS suggestion FROM events WHERE regexp_matches(props, '7') GROUP BY 1 HAVING count(*) >= 10 UNION ALL SELECT 'hot errors', 'raise the retry delay' FROM (SELECT (SELECT count(*) FROM events WHERE event_type = 'error') AS e, (SELECT count(*) FROM (SELECT s / nullif(epoch(\"at\" - lag(\"at\") OVER (ORDER BY \"at\")), 0) AS r FROM (SELECT date_trunc('hour', ts) AS \"at\", sum(length(props)) AS s FROM events WHERE event_type = 'error' GROUP BY 1)) WHERE r >= 0.001) AS b) WHERE e >= 5 AND b >= 2")
def _(spark, d):
    e = _events(spark, d)
    lines = e.select(F.concat_ws(" ", "event_type", "props").alias("line"))
    logs = advisor.log_conditions(lines, "line", [advisor.LogCondition("errors", "^error ", 5), advisor.LogCondition("sevens", "7", 10), advisor.LogCondition("none", "no such line")])
    history = trace.tickers(e, "ts", "event_type", F.length("props"))
    rates = advisor.rate_conditions(history, "at", "total", [advisor.RateCondition("bursts", "error", 0.001, 2)])
    return advisor.advise(logs.unionByName(rates), _RULES)


@query("deletion_trigger_ratio", "SELECT user_id, round(sum(CAST(event_type = 'error' AS INT)) / count(*), 8) AS ratio, sum(CAST(event_type = 'error' AS INT)) / count(*) >= 0.2 AS flagged FROM events GROUP BY 1")
def _(spark, d):
    return resolve.deletion_ratio(_events(spark, d), "user_id", F.col("event_type") == "error", 0.2).withColumn("ratio", F.round("ratio", 8))


@query("sketch_merge", f"SELECT cx, cy, count(*) AS n FROM (SELECT {_CELL_SQL} FROM {_BOXES_SQL}) GROUP BY 1, 2")
def _(spark, d):
    parts = [_sketch(spark, d, F.col("l_linenumber") % 2 == i) for i in (0, 1)]
    return parts[0].unionByName(parts[1]).groupBy("cx", "cy").agg(F.sum("n").alias("n"))


@query("sketch_area", f"SELECT (max(cx) - min(cx) + 1) * (max(cy) - min(cy) + 1) AS area, 2 * ((max(cx) - min(cx) + 1) + (max(cy) - min(cy) + 1)) AS perimeter FROM (SELECT {_CELL_SQL} FROM {_BOXES_SQL})")
def _(spark, d):
    w, h = F.max("cx") - F.min("cx") + 1, F.max("cy") - F.min("cy") + 1
    return _sketch(spark, d).agg((w * h).alias("area"), (2 * (w + h)).alias("perimeter"))


@query("key_counts", "SELECT CASE WHEN event_id <= 200 THEN 200 WHEN event_id <= 700 THEN 700 END AS stripe, count(*) AS entries, count(DISTINCT user_id) AS keys FROM events GROUP BY 1")
def _(spark, d):
    rows = _events(spark, d).withColumn("stripe", resolve.stripe_of(resolve.Log(key=("user_id",), seq="event_id"), [200, 700]))
    return rows.groupBy("stripe").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("user_id").alias("keys"))


@query("box_groups")
def _(spark, d):
    return grouping.group_boxes(_boxes(spark, d), ("xmin", "xmax", "ymin", "ymax"), "l_suppkey", "l_orderkey", 0.5)


@query("range_groups")
def _(spark, d):
    e = _events(spark, d).select("user_id", "event_id", F.col("value").alias("lo"), (F.col("value") + 1).alias("hi"))
    return grouping.group_ranges(e, "lo", "hi", "user_id", "lo", 5.0)
