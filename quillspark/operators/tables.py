"""Extracted tables: cells, header, records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_cells(rows: Column) -> Column:
    """Null cells as empty texts."""
    return F.transform(rows, lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))


def header(rows: Column) -> Column:
    return F.coalesce(F.try_element_at(rows, F.lit(1)), F.array().cast("array<string>"))


def records(rows: Column) -> Column:
    """A map per row below the header, as long as the shorter of row and header; of equal names the last one holds.
    Tables of fewer than two rows have none."""
    top = header(rows)

    def record(row):
        n = F.least(F.size(row), F.size(top))
        keys, values = F.slice(top, 1, n), F.slice(row, 1, n)
        last = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ~F.array_contains(F.slice(keys, i + 1, F.greatest(n - i, F.lit(0))), F.element_at(keys, i)))
        return F.map_from_arrays(F.transform(last, lambda i: F.element_at(keys, i)), F.transform(last, lambda i: F.element_at(values, i)))

    return F.when(F.size(rows) >= 2, F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1))), record)).otherwise(F.array().cast("array<map<string,string>>"))
