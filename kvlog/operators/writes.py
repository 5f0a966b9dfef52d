"""Write batches: operations in order, checked as they are added, committed as consecutive sequences of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlog.operators.merge import FOLDS
from kvlog.operators.ordering import numbered
from kvlog.operators.schema import DELETE, MERGE, PUT, SINGLE_DELETE

DELETE_RANGE, PUT_ENTITY = "delete_range", "put_entity"
BATCH_SCHEMA = "ordinal long, op string, key string, end string, value string, columns map<string,string>"


class InvalidArgument(ValueError):
    """An operation that the store must refuse."""


class NotSupported(ValueError):
    """An operation that the store isn't set up for."""


class WriteBatch:
    """A batch that a program builds operation by operation; large batches are DataFrames with an ordinal (see below)."""

    def __init__(self, merge_operator: str | None = None, timestamps: bool = False):
        if merge_operator is not None and merge_operator not in FOLDS:
            raise InvalidArgument(f"unknown merge operator {merge_operator!r}")
        self.merge_operator, self.timestamps = merge_operator, timestamps
        self.rows: list[tuple] = []
        self.marks: list[int] = []

    def _add(self, op: str, key: str, end: str | None = None, value: str | None = None, columns: dict[str, str] | None = None) -> WriteBatch:
        self.rows.append((len(self.rows), op, key, end, value, columns))
        return self

    def put(self, key: str, value: str) -> WriteBatch:
        return self._add(PUT, key, value=value)

    def put_entity(self, key: str, columns: dict[str, str]) -> WriteBatch:
        """Wide columns, kept in the order of their names; the column '' is the plain value."""
        return self._add(PUT_ENTITY, key, value=columns.get(""), columns=dict(sorted(columns.items())))

    def delete(self, key: str) -> WriteBatch:
        return self._add(DELETE, key)

    def single_delete(self, key: str) -> WriteBatch:
        return self._add(SINGLE_DELETE, key)

    def merge(self, key: str, operand: str) -> WriteBatch:
        if self.merge_operator is None:
            raise NotSupported("merge needs a merge operator")
        return self._add(MERGE, key, value=operand)

    def delete_range(self, begin: str, end: str) -> WriteBatch:
        """Covers begin <= key < end; nothing where both are equal."""
        if self.timestamps:
            raise NotSupported("range deletes with timestamps")
        if begin > end:
            raise InvalidArgument(f"begin {begin!r} is after end {end!r}")
        return self._add(DELETE_RANGE, begin, end=end)

    def set_save_point(self) -> None:
        self.marks.append(len(self.rows))

    def rollback_to_save_point(self) -> None:
        if not self.marks:
            raise InvalidArgument("no save point")
        del self.rows[self.marks.pop() :]

    def pop_save_point(self) -> None:
        if not self.marks:
            raise InvalidArgument("no save point")
        self.marks.pop()

    def clear(self) -> None:
        self.rows, self.marks = [], []

    def count(self) -> int:
        return len(self.rows)

    def has(self, op: str) -> bool:
        return any(r[1] == op for r in self.rows)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, BATCH_SCHEMA)


def rollback(batch: DataFrame, ordinal: str, mark: int) -> DataFrame:
    """A batch without what was added after the save point ``mark`` (the number of operations before it)."""
    return batch.where(F.col(ordinal) < mark)


def checked(batch: DataFrame, merge_operator: str | None = None) -> DataFrame:
    """The batch; reading it raises where it has a range delete whose begin is after its end, or a merge without an operator."""
    bad = F.when((F.col("op") == DELETE_RANGE) & (F.col("key") > F.col("end")), F.raise_error(F.lit("range delete: begin is after end")))
    if merge_operator is None:
        bad = bad.when(F.col("op") == MERGE, F.raise_error(F.lit("merge needs a merge operator")))
    return batch.withColumn("op", F.coalesce(bad.cast("string"), F.col("op")))


def commit(log: DataFrame, batch: DataFrame, ordinal: str = "ordinal", seq: str = "seq") -> DataFrame:
    """The log with the batch's operations after all others, as consecutive sequences in the order of ``ordinal``."""
    first = (log.agg(F.max(seq)).first()[0] or 0) + 1
    new = numbered(batch, ordinal, alias=seq, start=first).withColumn(seq, F.col(seq).cast("long"))
    return log.unionByName(new.drop(ordinal), allowMissingColumns=True)


def split_log(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(point operations, range tombstones (begin, end, seq)) of a committed log."""
    is_range = F.col("op") == DELETE_RANGE
    return log.where(~is_range).drop("end"), log.where(is_range).select(F.col("key").alias("begin"), "end", "seq")


def replay(trace: DataFrame, ts: str, op: Column) -> DataFrame:
    """The write operations of a recorded trace, in its order, as a batch (ordinal first)."""
    return numbered(trace.where(op.isin(PUT, DELETE, SINGLE_DELETE, MERGE, DELETE_RANGE)), ts, alias="ordinal")


def recover(log: DataFrame, seq: str, decision: Column, stop: str = "stop", ignore: str = "ignore") -> DataFrame:
    """What a filter over log records lets through at recovery: ignored records are left out, and all from the first one that
    says stop on."""
    first = log.where(decision == stop).agg(F.min(seq).alias("_stop"))
    kept = log.where(~F.coalesce(decision == ignore, F.lit(False)))
    return kept.crossJoin(F.broadcast(first)).where(F.col("_stop").isNull() | (F.col(seq) < F.col("_stop"))).drop("_stop")


def prepared(log: DataFrame, commits: DataFrame, txn: str) -> DataFrame:
    """Rows outside transactions, and those of committed ones: what is prepared alone stays invisible."""
    own = log.where(F.col(txn).isNotNull()).join(commits.select(txn).distinct(), txn, "left_semi").select(*log.columns)
    return log.where(F.col(txn).isNull()).unionByName(own)
