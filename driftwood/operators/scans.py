"""Ordered scans over keys of any size.

A window partitioned by a key is one task's work, however many rows the key has.  Here rows are dealt into ranges of
(key, order) instead, so a key of very many rows spans many ranges.  Windows run inside a range; a second pass over the
few keys that cross a range's edge (two a range at most) carries what the ranges before hold: sums, or the last row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.operators.staging import staged

#: The range of a row, and its place among rows that tie.
PART, PLACE = "scan_part", "scan_place"

#: How a total of two stretches follows from theirs.
_JOINED: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column], object]] = {
    "sum": (F.sum, lambda a, b: a + b, 0),
    "bit_xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b), 0),
    "max": (F.max, lambda a, b: F.greatest(a, b), None),
}


class Scan:
    """Rows in ranges of (keys, order).  `rows` may get columns by `with_columns`; keys and order stay.

    Nulls are keys like others and come first in an order.  Rows that tie in `order` are taken in the order in which
    they are read.  No rows give no rows.
    """

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str]):
        self.keys, self.order = keys, order
        placed = rows.withColumn(PLACE, F.monotonically_increasing_id())
        self.rows = staged(placed.repartitionByRange(*keys, *order, PLACE).withColumn(PART, F.spark_partition_id()), "ranges")
        key = F.struct(*[F.col(f"`{k}`") for k in keys])
        ends = self.rows.groupBy(PART).agg(F.min(key).alias("low"), F.max(key).alias("high"))
        ends = ends.select(PART, F.explode(F.array_distinct(F.array("low", "high"))).alias("scan_key"))
        # at most two rows a range, however many keys there are
        self.edges = staged(ends.withColumn("n", F.count("*").over(Window.partitionBy("scan_key"))).where("n > 1").drop("n"), "edges")

    def _local(self) -> Window:
        return Window.partitionBy(PART, *self.keys).orderBy(*self.order, PLACE)

    def _edge_rows(self) -> DataFrame:
        key = F.struct(*[F.col(f"`{k}`") for k in self.keys])
        return self.rows.withColumn("scan_key", key).join(F.broadcast(self.edges), [PART, "scan_key"])

    def _carried(self, table: DataFrame, columns: list[str]) -> DataFrame:
        """self.rows with the `columns` of the row of `table` for the range and key, null where there is none."""
        held = F.broadcast(table.select(F.col(PART).alias("edge_part"), F.col("scan_key").alias("edge_key"), *columns))
        same = (F.col(PART) == F.col("edge_part")) & F.struct(*[F.col(f"`{k}`") for k in self.keys]).eqNullSafe(F.col("edge_key"))
        return self.rows.join(held, same, "left").drop("edge_part", "edge_key")

    def with_columns(self, **columns: Column) -> Scan:
        self.rows = self.rows.withColumns(columns)
        return self

    def where(self, condition: Column | str) -> Scan:
        self.rows = self.rows.where(condition)
        return self

    def running(self, **columns: tuple[str, Column]) -> Scan:
        """Adds, per name, the total ("sum", "bit_xor" or "max") of a column over the key's rows up to and with each row.  Sums take nulls for 0."""
        totals = self._edge_rows().groupBy(PART, "scan_key").agg(*[_JOINED[how][0](c).alias(name) for name, (how, c) in columns.items()])
        earlier = Window.partitionBy("scan_key").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(PART, "scan_key", *[_JOINED[how][0](name).over(earlier).alias(f"scan_{name}") for name, (how, _) in columns.items()])
        upto = self._local().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self.rows = self.rows.select("*", *[_JOINED[how][0](c).over(upto).alias(name) for name, (how, c) in columns.items()])
        joined = self._carried(carry, [f"scan_{name}" for name in columns])
        for name, (how, _) in columns.items():
            _, both, none = _JOINED[how]
            filled = [F.coalesce(F.col(x), F.lit(none)) for x in (name, f"scan_{name}")] if none is not None else [F.col(name), F.col(f"scan_{name}")]
            joined = joined.withColumn(name, both(*filled)).drop(f"scan_{name}")
        self.rows = joined
        return self

    def previous(self, **columns: Column) -> Scan:
        """Adds, per name, a column's value in the key's row before; null in its first row."""
        whole = F.struct(*[c.alias(name) for name, c in columns.items()])
        order = F.struct(*self.order, PLACE)
        last = self._edge_rows().groupBy(PART, "scan_key").agg(F.max_by(whole, order).alias("scan_last"))
        carry = last.withColumn("scan_last", F.lag("scan_last").over(Window.partitionBy("scan_key").orderBy(PART)))
        w = self._local()
        self.rows = self.rows.select("*", F.row_number().over(w).alias("scan_n"), F.lag(whole).over(w).alias("scan_before"))
        joined = self._carried(carry, ["scan_last"])
        joined = joined.withColumn("scan_before", F.when(F.col("scan_n") == 1, F.col("scan_last")).otherwise(F.col("scan_before")))
        self.rows = joined.select("*", *[F.col(f"scan_before.{name}").alias(name) for name in columns]).drop("scan_n", "scan_before", "scan_last")
        return self

    def result(self) -> DataFrame:
        return self.rows.drop(PART, PLACE)
