"""Points where a program adds its own parts; each is a function of columns or a Spark interface, by name where it is looked up.

Merge operators: ``merge.register``; aggregators: ``merge.register_aggregator``; cache policies: ``caches.register``; compaction
filters: arguments of ``compact.compact``; prefix transforms: functions Column -> Column, as in ``ranges``; log filters:
``writes.recover``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

#: Comparators: name -> the sort keys of a key.
COMPARATORS: dict[str, Callable[[Column], list[Column]]] = {
    "bytewise": lambda k: [k.asc()],
    "reverse_bytewise": lambda k: [k.desc()],
    "length_then_bytes": lambda k: [F.octet_length(k).asc(), k.asc()],
}


def register_comparator(name: str, keys: Callable[[Column], list[Column]]) -> None:
    COMPARATORS[name] = keys


def order_by(df: DataFrame, key: str, comparator: str = "bytewise") -> DataFrame:
    return df.orderBy(*COMPARATORS[comparator](F.col(key)))


#: Properties collectors: name -> aggregate over a table's rows.
COLLECTORS: dict[str, Column] = {}


def register_collector(name: str, aggregate: Callable[[], Column]) -> None:
    """aggregate builds the column once a session is there."""
    COLLECTORS[name] = aggregate


def collected(df: DataFrame) -> tuple[DataFrame, Observation]:
    """df, and an observation that holds every collector's property once df has been written or counted: no pass of its own."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("entries"), *[a().alias(n) for n, a in COLLECTORS.items()]), seen


def write_filtered(df: DataFrame, path: str, *keys: str, rows: int = 1_000_000, fpp: float = 0.01) -> None:
    """Parquet with a Bloom filter for each key column, which point lookups use to skip row groups."""
    w = df.write
    for k in keys:
        w = w.option(f"parquet.bloom.filter.enabled#{k}", "true").option(f"parquet.bloom.filter.expected.ndv#{k}", str(rows)).option(f"parquet.bloom.filter.fpp#{k}", str(fpp))
    w.parquet(path)


#: Partitioners: name -> the value at whose change a new file begins.
PARTITIONERS: dict[str, Callable[[Column], Column]] = {"prefix1": lambda k: F.substring(k.cast("string"), 1, 1), "prefix2": lambda k: F.substring(k.cast("string"), 1, 2)}


def write_partitioned(df: DataFrame, path: str, key: str, partitioner: str) -> None:
    df.withColumn("partition", PARTITIONERS[partitioner](F.col(key))).repartition("partition").sortWithinPartitions("partition", key).write.partitionBy("partition").parquet(path)


class Events(StreamingQueryListener):
    """Tells a program's functions of streams that begin, move on and end."""

    def __init__(self, started: Callable | None = None, progressed: Callable | None = None, ended: Callable | None = None):
        self.calls = (started, progressed, ended)

    def _tell(self, i: int, event) -> None:
        if self.calls[i]:
            self.calls[i](event)

    def onQueryStarted(self, event) -> None:
        self._tell(0, event)

    def onQueryProgress(self, event) -> None:
        self._tell(1, event)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None:
        self._tell(2, event)


def listen(spark: SparkSession, events: Events) -> None:
    spark.streams.addListener(events)
