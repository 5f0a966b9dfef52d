"""Ordered folds of merge operands.

The fold of a key: operands after the newest put or delete, oldest first, over that put's value (nothing after a delete).
``FOLDS`` maps a name to a function of (base column, array of operands oldest first); ``register`` adds more.  Folds that
are associative and commutative have a plain aggregate in ``AGGREGATES``, which combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlog.functions.coding import fixed64, to_fixed64
from kvlog.operators.schema import DELETE, MERGE, SINGLE_DELETE, Log

Fold = Callable[[Column, Column], Column]


def _all(base: Column, operands: Column) -> Column:
    return F.when(base.isNull(), operands).otherwise(F.concat(F.array(base), operands))


def wrapped(x: Column) -> Column:
    """A whole number (decimal) as a 64-bit integer that wraps around."""
    whole = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    m = F.pmod(x, whole(1 << 64)).cast("decimal(20,0)")
    return F.when(m >= whole(1 << 63), m - whole(1 << 64)).otherwise(m).cast("long")


def _wide(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def _fixed64(x: Column) -> Column:
    """A binary operand of 8 bytes as an integer, the lowest byte first; one of another size counts as 0."""
    return F.when(F.octet_length(x) == 8, fixed64(x)).otherwise(F.lit(0).cast("long"))


def _bytes_xor(a: Column, b: Column) -> Column:
    """Byte by byte; the tail of the longer one is kept."""
    n = F.greatest(F.octet_length(a), F.octet_length(b))
    at = lambda x, i: F.when(i <= F.octet_length(x), F.conv(F.hex(F.substr(x, i, F.lit(1))), 16, 10).cast("int")).otherwise(0)
    digits = F.transform(F.sequence(F.lit(1), n), lambda i: F.lpad(F.hex(at(a, i).bitwiseXOR(at(b, i)).cast("long")), 2, "0"))
    return F.when(n == 0, a).otherwise(F.unhex(F.array_join(digits, "")))


def appending(delimiter: str) -> Fold:
    return lambda base, ops: F.array_join(_all(base, ops), delimiter)


FOLDS: dict[str, Fold] = {
    "put": lambda base, ops: F.coalesce(F.try_element_at(ops, F.lit(-1)), base),
    # sum and product wrap around at 64 bits
    "sum": lambda base, ops: wrapped(F.aggregate(ops, _wide(F.coalesce(base, F.lit(0))), lambda a, x: _wide(a + _wide(x)))),
    "mul": lambda base, ops: F.aggregate(ops, F.coalesce(base, F.lit(1)).cast("long"), lambda a, x: wrapped(_wide(a) * _wide(x.cast("long")))),
    "uint64add": lambda base, ops: to_fixed64(wrapped(F.aggregate(_all(base, ops), _wide(F.lit(0)), lambda a, x: _wide(a + _wide(_fixed64(x)))))),
    # numbers by value, strings and binaries byte-wise
    "max": lambda base, ops: F.array_max(_all(base, ops)),
    "xor": lambda base, ops: F.aggregate(ops, F.coalesce(base, F.lit(0)).cast("long"), lambda a, x: a.bitwiseXOR(x.cast("long"))),
    "bytesxor": lambda base, ops: F.aggregate(_all(base, ops), F.lit(b""), _bytes_xor),
    "append": appending(","),
    # operands only: the existing value is ignored
    "sortlist": lambda base, ops: F.array_sort(F.flatten(F.transform(ops, lambda x: F.split(x, ",").cast("array<int>")))),
    # newest operand first, each operand's own order kept
    "last3": lambda base, ops: F.slice(F.flatten(F.transform(F.reverse(_all(base, ops)), lambda x: F.split(x, ","))), 1, 3),
}

AGGREGATES: dict[str, Callable[[Column], Column]] = {"sum": lambda c: wrapped(F.sum(_wide(c))), "max": F.max, "xor": F.bit_xor, "min": F.min}


def register(name: str, fold: Fold, aggregate: Callable[[Column], Column] | None = None) -> None:
    """A merge operator; aggregate: the same as a plain aggregate, for folds that are associative and commutative."""
    FOLDS[name] = fold
    AGGREGATES.pop(name, None)
    if aggregate is not None:
        AGGREGATES[name] = aggregate


#: Aggregators of agg_merge: (result so far, next operand) -> result.
STEPS: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, x: wrapped(_wide(a) + _wide(x)),
    "mul": lambda a, x: wrapped(_wide(a) * _wide(x)),
    "max": lambda a, x: F.greatest(a, x),
    "min": lambda a, x: F.least(a, x),
}


def register_aggregator(name: str, step: Callable[[Column, Column], Column]) -> None:
    STEPS[name] = step


def operands(log: DataFrame, d: Log, limit: int | None = None) -> DataFrame:
    """Raw operands of each key, oldest first; status 'incomplete' where there are more than ``limit``."""
    out = log.groupBy(*d.key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(d.seq).alias("s"), F.col(d.value[0]).alias("v")))), lambda x: x["v"]).alias("operands"))
    too_many = F.lit(False) if limit is None else F.size("operands") > limit
    return out.withColumn("status", F.when(too_many, "incomplete").otherwise("ok"))


def _above_base(log: DataFrame, d: Log) -> tuple[DataFrame, DataFrame]:
    """The newest put or delete of each key, and the operands above it: what is older never reaches a collect."""
    is_merge = F.col(d.op) == MERGE
    base = log.where(~is_merge).groupBy(*d.key).agg(F.max_by(F.struct(F.col(d.seq).alias("s"), F.col(d.op).alias("op"), F.col(d.value[0]).alias("v")), d.seq).alias("_b"))
    own = log.where(is_merge).alias("l").join(base.select(*d.key, F.col("_b.s").alias("_bs")).alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in d.key], "left")
    return base, own.where(F.col("_bs").isNull() | (F.col(f"l.{d.seq}") > F.col("_bs"))).select("l.*")


def _with_base(base: DataFrame, per: DataFrame, d: Log) -> DataFrame:
    """(key, start, rest of per) for every key of either: start is the base's value, null after a delete."""
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in d.key]
    start = F.when(~F.col("_b.op").isin(DELETE, SINGLE_DELETE), F.col("_b.v"))
    rest = [c for c in per.columns if c not in d.key]
    return base.alias("l").join(per.alias("r"), on, "full").select(*[F.coalesce(f"l.{c}", f"r.{c}").alias(c) for c in d.key], start.alias("_start"), *rest)


def fold(log: DataFrame, d: Log, name: str, seq: int | None = None) -> DataFrame:
    """The folded value of each key; keys with neither base nor operands are left out.  Folds that are plain aggregates are
    combined before the shuffle; others collect a key's operands above its newest base, in order."""
    if name in AGGREGATES:
        return fold_fast(log, d, name, seq)
    if seq is not None:
        log = log.where(F.col(d.seq) <= seq)
    if not d.op:
        log, d = log.withColumn("_op", F.lit(MERGE)), Log(key=d.key, seq=d.seq, value=d.value, op="_op")
    base, above = _above_base(log, d)
    if name == "put":
        last = _with_base(base, above.groupBy(*d.key).agg(F.max_by(d.value[0], d.seq).alias("_last")), d)
        return last.select(*d.key, F.coalesce("_last", "_start").alias("value")).where(F.col("value").isNotNull())
    ops = F.transform(F.array_sort(F.collect_list(F.struct(F.col(d.seq).alias("s"), F.col(d.value[0]).alias("v")))), lambda x: x["v"])
    got = _with_base(base, above.groupBy(*d.key).agg(ops.alias("_vals")), d)
    kind = dict(log.dtypes)[d.value[0]]
    values = F.coalesce("_vals", F.array().cast(f"array<{kind}>"))
    return got.where(F.col("_start").isNotNull() | F.col("_vals").isNotNull()).select(*d.key, FOLDS[name](F.col("_start"), values).alias("value"))


def fold_fast(log: DataFrame, d: Log, name: str, seq: int | None = None) -> DataFrame:
    """As ``fold`` for the operators of AGGREGATES: operands are combined before the shuffle, however many a key has."""
    if seq is not None:
        log = log.where(F.col(d.seq) <= seq)
    if not d.op:
        return log.groupBy(*d.key).agg(AGGREGATES[name](F.col(d.value[0])).alias("value"))
    base, above = _above_base(log, d)
    per = _with_base(base, above.groupBy(*d.key).agg(AGGREGATES[name](F.col(d.value[0])).alias("_ops")), d)
    both = per.where(F.col("_start").isNotNull() | F.col("_ops").isNotNull()).select(*d.key, F.explode(F.array("_start", "_ops")).alias("v"))
    return both.where(F.col("v").isNotNull()).groupBy(*d.key).agg(AGGREGATES[name](F.col("v")).alias("value"))


def agg_merge(log: DataFrame, d: Log, func: str, value: str) -> DataFrame:
    """Operands that name their function (of STEPS): a run of one function is folded, then its result is the first operand of
    the next run.  An empty name takes the function of the next named operand.  Where a name is unknown the key's result is
    null with status 'error' and all its operands packed, oldest first."""
    back = Window.partitionBy(*d.key).orderBy(d.seq).rowsBetween(0, Window.unboundedFollowing)
    named = log.withColumn("_f", F.coalesce(F.first(F.when(F.col(func) != "", F.col(func)), ignorenulls=True).over(back), F.lit("")))
    rows = named.groupBy(*d.key).agg(F.array_sort(F.collect_list(F.struct(F.col(d.seq).alias("s"), F.col("_f").alias("f"), F.col(value).cast("long").alias("v")))).alias("_o"))

    def step(a: Column, x: Column) -> Column:
        out = F.when(a.isNull(), x["v"])
        for name, one in STEPS.items():
            out = out.when(x["f"] == name, one(a, x["v"]))
        return out

    known = F.forall("_o", lambda x: x["f"].isin(*STEPS))
    packed = F.when(~known, F.transform("_o", lambda x: x["v"]))
    return rows.select(*d.key, F.when(known, F.aggregate("_o", F.lit(None).cast("long"), step)).alias("value"), F.when(known, "ok").otherwise("error").alias("status"), packed.alias("packed"))
