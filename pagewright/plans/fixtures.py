"""Small literal tables that Spark and SQL read alike."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SQL_TYPES = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE", "timestamp": "TIMESTAMP"}


@dataclass(frozen=True)
class Literal:
    """``columns``: name and type by turns, as in "url string, seq long"."""

    columns: str
    rows: tuple

    def names(self) -> list[tuple[str, str]]:
        return [tuple(c.split()) for c in self.columns.split(", ")]

    def frame(self, spark: SparkSession) -> DataFrame:
        plain = spark.createDataFrame(list(self.rows), self.columns.replace("timestamp", "string"))
        return plain.select(*[plain[n].cast(t).alias(n) for n, t in self.names()])

    def sql(self) -> str:
        """A FROM item for DuckDB, without its name."""
        show = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
        rows = ", ".join("(" + ", ".join(show(v) for v in row) + ")" for row in self.rows)
        casts = ", ".join(f"CAST(c{i} AS {SQL_TYPES[t]}) AS {n}" for i, (n, t) in enumerate(self.names()))
        return f"(SELECT {casts} FROM (VALUES {rows}) AS v({', '.join(f'c{i}' for i in range(len(self.names())))}))"
