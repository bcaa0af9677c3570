"""Small fixed tables as literal rows: no Python worker, and Spark knows their size."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from ..schemas import struct


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP'{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE'{value.isoformat()}'"
    if isinstance(value, int):
        return f"{value}L"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    fields = struct(ddl).fields
    typed = ", ".join(f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in fields)
    names = ", ".join(f"`{f.name}`" for f in fields)
    listed = rows or [(None,) * len(fields)]
    values = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in listed)
    return spark.sql(f"SELECT {typed} FROM VALUES {values} AS v({names})" + ("" if rows else " WHERE false"))
