"""Numbers over all rows of a table without sorting them in one task.

Rows are counted per file; running sums over the files, of which there are few, give
each file's first number, and a row's place in its file does the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_rows(rows: DataFrame, file: str = "src_file", row: str = "row") -> DataFrame:
    """Adds number: files in order of their names, in each its rows in order.

    `row` must count the rows of a file without gaps, from any start: the row index of a
    Parquet file, or an increasing id taken from a scan that doesn't split files.
    """
    counted = rows.groupBy(F.col(file).alias("of_file")).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("first"))
    # One row per file is all that this window sees.
    order = Window.orderBy("of_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("of_file", "first", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    numbered = rows.join(starts, F.col(file) == F.col("of_file"))
    return numbered.select(*rows.columns, (F.col("before") + F.col(row) - F.col("first")).alias("number"))
