"""Statistics that are kept by changes: what went out is taken off, what came in is added."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.operators.upsert import BucketedTable


def counted(rows: DataFrame, keys: list[str], measures: dict[str, Column], sign: int = 1) -> DataFrame:
    """Sums of whole-number measures by keys."""
    return rows.groupBy(*keys).agg(*(F.coalesce(F.sum(F.lit(sign) * m.cast("long")), F.lit(0)).cast("long").alias(name) for name, m in measures.items()))


class Counters:
    """Sums by keys in a bucketed table: a change of some rows touches the buckets of their keys alone.

    ``measures`` are whole numbers of a row, such as 1 for a count or a condition cast to int.  Keys are
    compared as values: use a name of their own for rows without one, as a null never joins.
    """

    def __init__(self, table: BucketedTable, measures: dict[str, Column]):
        self.table, self.measures = table, measures

    def change(self, gone: DataFrame | None, come: DataFrame | None) -> None:
        """Takes off the rows that are gone (or were changed, as they were) and adds those that have come (as they are)."""
        names, keys = list(self.measures), self.table.keys
        parts = [counted(rows, keys, self.measures, sign) for rows, sign in ((gone, -1), (come, 1)) if rows is not None]
        add = lambda rows: rows.groupBy(*keys).agg(*(F.sum(n).cast("long").alias(n) for n in names))
        some = reduce(lambda x, y: x | y, (F.col(n) != 0 for n in names))
        self.table.upsert(add(reduce(DataFrame.unionByName, parts)), lambda old, new: add(old.unionByName(new)).where(some))

    def read(self) -> DataFrame | None:
        return self.table.read()

    def drift(self, rows: DataFrame) -> DataFrame:
        """The keys whose kept sums differ from those of all rows, with both; none if all is well."""
        names, keys = list(self.measures), self.table.keys
        full = counted(rows, keys, self.measures)
        kept = self.read()
        kept = full.limit(0) if kept is None else kept
        both = full.select(*keys, F.struct(*names).alias("full")).join(kept.select(*keys, F.struct(*names).alias("kept")), keys, "full_outer")
        zero = F.struct(*(F.lit(0).cast("long").alias(n) for n in names))
        return both.where(F.coalesce("full", zero) != F.coalesce("kept", zero))


def counted_upsert(store: BucketedTable, counters: Counters, new: DataFrame) -> None:
    """An upsert of a store and of its counters: only the rows that are replaced are read again."""
    old = store.lookup(new)
    counters.change(old, new)
    store.upsert(new)


def counted_delete(store: BucketedTable, counters: Counters, gone: DataFrame) -> None:
    """A deletion from a store and from its counters."""
    old = store.lookup(gone)
    if old is not None:
        counters.change(old, None)
        store.delete(gone)
