"""Small tables that exist both as DataFrames and as SQL text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Fixture:
    """Rows under a Spark schema string; sql() gives the same rows as a parenthesised query for DuckDB."""

    schema: str
    rows: tuple[tuple, ...]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    def sql(self) -> str:
        names = [c.strip().rsplit(" ", 1) for c in self.schema.split(",")]
        kinds = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<long>": "BIGINT[]"}

        def lit(v: object) -> str:
            if v is None:
                return "NULL"
            if isinstance(v, bool):
                return str(v).upper()
            if isinstance(v, str):
                parts = ["'" + x.replace("'", "''") + "'" for x in v.split("\n")]
                return parts[0] if len(parts) == 1 else "(" + " || chr(10) || ".join(parts) + ")"
            if isinstance(v, (list, tuple)):
                return "[" + ", ".join(map(lit, v)) + "]"
            return str(v)

        rows = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in self.rows)
        cols = ", ".join(f"CAST({n} AS {kinds[k]}) AS {n}" for n, k in names)
        return f"(SELECT {cols} FROM (VALUES {rows}) AS v({', '.join(n for n, _ in names)}))"
