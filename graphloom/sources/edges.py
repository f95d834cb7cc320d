"""Two-column edge tables from files or DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pick_column(df: DataFrame, column: int | str) -> str:
    """The name of a column given by 1-based position or by name.

    Raises ValueError for a position out of bounds or an unknown name, TypeError for
    any other kind of specification; no job runs.
    """
    if isinstance(column, bool) or not isinstance(column, int | str):
        raise TypeError(f"a column is given by position or name, not by {column!r}")
    if isinstance(column, str):
        if column not in df.columns:
            raise ValueError(f"no column {column!r}; there are {df.columns}")
        return column
    if not 1 <= column <= len(df.columns):
        raise ValueError(f"column {column} is out of bounds: there are {len(df.columns)} columns")
    return df.columns[column - 1]


def two_columns(df: DataFrame, col1: int | str = 1, col2: int | str = 2, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Two chosen columns of ``df`` as strings; at least two columns must exist."""
    if not isinstance(df, DataFrame):
        raise TypeError(f"edges come as a DataFrame, not as {type(df).__name__}")
    if len(df.columns) < 2:
        raise ValueError("an edge table has at least two columns")
    picked = [pick_column(df, c) for c in (col1, col2)]
    return df.select(*[F.col("`" + c.replace("`", "``") + "`").cast("string").alias(n) for c, n in zip(picked, names)])


def read_edges(
    spark: SparkSession,
    path: str,
    header: bool = True,
    sep: str = "\t",
    comment: str | None = None,
    null_value: str | None = None,
) -> DataFrame:
    """A delimited text file with every column as a string: quotes are ordinary characters.

    Ids are never interpreted (``007`` stays ``007``). A missing path raises ValueError.
    """
    reader = spark.read.option("header", header).option("sep", sep).option("quote", "").option("inferSchema", False)
    if comment is not None:
        reader = reader.option("comment", comment)
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    try:
        return reader.csv(path)
    except Exception as error:
        raise ValueError(f"cannot read {path}: {error}") from error
