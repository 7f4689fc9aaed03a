"""Writing outputs: replaced tables, seeded tables, the CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.view import export_rows
from ..session import compiled

# Columns of the master that serve the build only.
BOOKKEEPING = ("_sources", "_curated_row_index", "_bulk_row_index")


def replace(df: DataFrame, path: str, format: str = "parquet", partition_by: str | None = None) -> None:
    """Overwrite a table."""
    writer = df.write.mode("overwrite").format(format)
    with compiled(df.sparkSession):
        (writer.partitionBy(partition_by) if partition_by else writer).save(path)


def seed(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Write a table only if it does not exist; people edit it afterwards."""
    df.write.mode("ignore").format(format).save(path)


def export_json(df: DataFrame, path: str) -> None:
    """Write a table as JSON lines, missing values included, dates as ISO texts."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_csv(rows: DataFrame, path: str) -> None:
    """Write the rows, in their order, as CSV files with a header.

    Values with a quote, comma or newline are quoted and quotes are doubled;
    a missing value is an empty cell.
    """
    (
        export_rows(rows).write.mode("overwrite")
        .option("header", True).option("quote", '"').option("escape", '"')
        .option("emptyValue", "").option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
