"""Datasets (D15, Q1, S22-S26, X1, X2): a table by name, its schema, sample, profile and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.verify import column_profile
from . import readers

#: Words in a column's name that make it a time.
TIME_WORDS = ("date", "time", "timestamp", "created", "updated", "year")


class Dataset:
    """A table under a name (default `data`), for SQL and summaries."""

    def __init__(self, df: DataFrame, name: str = "data"):
        self.df, self.name = df, name

    def query(self, sql: str) -> DataFrame:
        """Q1: SQL over the table by its name."""
        self.df.createOrReplaceTempView(self.name)
        return self.df.sparkSession.sql(sql)

    def schema(self) -> dict[str, str]:
        return dict(self.df.dtypes)

    def sample(self, n: int = 5) -> list[dict]:
        return [r.asDict() for r in self.df.limit(n).collect()]

    def profile(self) -> DataFrame:
        """A31."""
        return column_profile(self.df)

    def summary(self) -> dict:
        """A32."""
        return {"rows": self.df.count(), "columns": len(self.df.columns), "dtypes": self.schema()}

    def with_times(self) -> Dataset:
        """Text columns whose name speaks of a time become timestamps, null where they don't parse."""
        kinds = dict(self.df.dtypes)
        found = [c for c in self.df.columns if kinds[c] == "string" and any(w in c.lower() for w in TIME_WORDS)]
        return Dataset(self.df.withColumns({c: F.try_to_timestamp(c) for c in found}), self.name)

    def records(self) -> DataFrame:
        """A JSON document a row."""
        return self.df.select(F.to_json(F.struct("*")).alias("record"))


def open_dataset(spark: SparkSession, path: str, name: str = "data", sheet=0, sql_table: str | None = None) -> Dataset:
    """By suffix. Workbooks and SQLite files come through pandas on the driver: both are single small files by nature."""
    low = path.lower()
    if low.endswith((".csv", ".tsv", ".tab", ".txt", ".csv.gz", ".tsv.gz")):
        return Dataset(readers.delimited(spark, path), name)
    if low.endswith((".parquet", "/")):
        return Dataset(spark.read.parquet(path), name)
    if low.endswith((".xlsx", ".xls")):
        import pandas as pd

        return Dataset(spark.createDataFrame(pd.read_excel(path, sheet_name=sheet)), name)
    if low.endswith((".sqlite", ".db")):
        import sqlite3

        import pandas as pd

        if not sql_table or not sql_table.isidentifier():
            raise ValueError("sql_table must name a table of the database")
        with sqlite3.connect(path) as con:
            return Dataset(spark.createDataFrame(pd.read_sql_query(f'SELECT * FROM "{sql_table}"', con)), name)
    raise ValueError(f"no reader for {path}")
