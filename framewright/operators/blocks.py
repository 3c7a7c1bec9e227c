"""Ordered work on the messages of a trace, cut in blocks of time where a trace is too long for one task.

Keys are counted first.  Where all have at most ``TRACE_ROWS`` rows, a window orders
each key in one task.  Otherwise a trace is cut in ``BLOCKS`` blocks of about as many
messages each, by quantiles of its times; messages of one time that fill several
blocks are dealt to them by their places in the table.  The results are the same.  Rows
are ordered within a block only; what a block needs of the earlier ones (sizes,
last rows, last known values) comes from a table of one row a block, joined on
the columns that the rows are dealt by already.  A caller with several such steps on
the same keys, or on longer ones, counts once and passes ``short``.

Rows whose key is null form a trace of their own; rows without a time come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import range_of, splitters, with_few

ORDER = ("ts_us", "idx_src")
#: Blocks of time that a trace is cut in.
BLOCKS = 256
#: Rows of one key that a task may order.
TRACE_ROWS = 20_000_000
BLOCK = ["_k", "_b"]


def in_blocks(df: DataFrame, keys: tuple[str, ...], trace: tuple[str, ...] | None = None) -> DataFrame:
    """Rows with their key (_k) and block (_b) of the time of their trace (by default the key)."""
    trace = keys[:1] if trace is None else trace
    by = lambda names: F.struct(*(F.col(n) for n in names)) if names else F.struct(F.lit(0))
    ends = df.groupBy(by(trace).alias("_f")).agg(splitters(F.col("ts_us"), BLOCKS).alias("_s"), F.min("idx_src").alias("_lo"), F.max("idx_src").alias("_hi"))  # one row a trace
    salt = F.coalesce((F.col("idx_src") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1), F.lit(0.0))
    at = range_of(F.col("_s"), F.col("ts_us"), BLOCKS, salt)
    # rows without a time come first, in blocks of their own
    early = F.floor(salt * BLOCKS).cast("int") - BLOCKS
    return with_few(df.withColumn("_f", by(trace)), ends, "_f").withColumns({"_k": by(keys), "_b": F.when(F.col("ts_us").isNull(), early).otherwise(at)}).drop("_f", "_s", "_lo", "_hi")


def fits(df: DataFrame, keys: tuple[str, ...]) -> bool:
    """Whether every key is short enough for one task."""
    most = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) <= TRACE_ROWS


def whole(keys: tuple[str, ...]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def in_order(*order: str):
    return Window.partitionBy(*BLOCK).orderBy(*(order or ORDER))


def place(df: DataFrame, keys: tuple[str, ...] = ("source_file",), name: str = "_nth", total: str | None = None, short: bool | None = None) -> DataFrame:
    """0-based place of each row among those of its key, and on wish the number of these."""
    if fits(df, keys) if short is None else short:
        counted = df.withColumn(total, F.count("*").over(whole(keys))) if total else df
        return counted.withColumn(name, (F.row_number().over(whole(keys).orderBy(*ORDER)) - 1).cast("bigint"))
    rows = in_blocks(df, keys)
    by_key = Window.partitionBy("_k")
    sizes = rows.groupBy(*BLOCK).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*BLOCK, before.alias("_before"), *([F.sum("_c").over(by_key).alias(total)] if total else []))
    placed = rows.withColumn("_r", F.row_number().over(in_order())).join(sizes, BLOCK)
    return placed.withColumn(name, F.col("_before") + F.col("_r") - 1).drop(*BLOCK, "_r", "_before")


def with_start(df: DataFrame, name: str = "_t0") -> DataFrame:
    """Rows with the first time of their file."""
    first = df.groupBy(F.struct("source_file").alias("_f")).agg(F.min("ts_us").alias(name))  # one row a file
    return with_few(df.withColumn("_f", F.struct("source_file")), first, "_f").drop("_f")


def last_values(df: DataFrame, n: int, value: Column, keys: tuple[str, ...] = ("source_file",), name: str = "_last", short: bool | None = None) -> DataFrame:
    """The values of the last ``n`` rows of the key up to each row, oldest first; fewer where it begins; nulls count."""
    if n == 1:
        return df.withColumn(name, F.array(value))
    if fits(df, keys) if short is None else short:
        last = F.collect_list(F.struct(value.alias("v"))).over(whole(keys).orderBy(*ORDER).rowsBetween(1 - n, 0))
        return df.withColumn(name, F.transform(last, lambda x: x.v))
    rows = in_blocks(df, keys)
    own = F.collect_list(F.struct(value.alias("v"))).over(in_order().rowsBetween(1 - n, 0))
    rows = rows.withColumns({"_own": own, "_r": F.row_number().over(in_order())})
    ends = rows.groupBy(*BLOCK).agg(F.max_by("_own", "_r").alias("_t"))
    # every block that exists has a row, so n - 1 blocks are enough
    held = F.flatten(F.collect_list("_t").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(1 - n, -1)))
    ends = ends.select(*BLOCK, held.alias("_p"))
    both = F.concat("_p", "_own")
    last = F.when(F.size("_own") == n, F.col("_own")).otherwise(F.slice(both, F.greatest(F.lit(1), F.size(both) - (n - 1)), F.lit(n)))
    return rows.join(ends, BLOCK).withColumn(name, F.transform(last, lambda x: x.v)).drop(*BLOCK, "_own", "_r", "_p")


def carried(df: DataFrame, columns: dict[str, Column], keys: tuple[str, ...] = ("source_file",), back: bool = False, short: bool | None = None) -> DataFrame:
    """New columns with the latest value known at each row of the key (``back``: the next one)."""
    order = [(F.desc if back else F.asc)(c) for c in ORDER]
    if fits(df, keys) if short is None else short:
        upto = whole(keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(v, ignorenulls=True).over(upto) for c, v in columns.items()})
    rows = in_blocks(df, keys)
    w = Window.partitionBy(*BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.last(v, ignorenulls=True).over(w) for c, v in columns.items()} | {"_r": F.row_number().over(w)})
    ends = rows.groupBy(*BLOCK).agg(*(F.max_by(c, "_r").alias(f"_{c}") for c in columns))
    before = Window.partitionBy("_k").orderBy(F.desc("_b") if back else F.asc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*BLOCK, *(F.last(f"_{c}", ignorenulls=True).over(before).alias(f"_{c}") for c in columns))
    out = rows.join(ends, BLOCK).withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in columns})
    return out.drop(*BLOCK, "_r", *(f"_{c}" for c in columns))
