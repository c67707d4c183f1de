"""Rows of a table as leaves, without JSON: each record is a group of rows, each cell a leaf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill import constants as C
from leafmill.functions.paths import path


def cells(rows: DataFrame, record_id: Column, name: str, index: Column, columns: dict[str, tuple[int, Column]]) -> DataFrame:
    """Leaves at name[index].column. columns: a tag and a text column each; a null cell is a NULL leaf. Float and double
    columns are refused, since their text differs between engines: cast them to a decimal first."""
    types = rows.select(*[v.alias(c) for c, (_, v) in columns.items()]).schema
    if bad := [f.name for f in types if f.dataType.typeName() in ("float", "double")]:
        raise ValueError(f"float-column: {bad}")
    items = [F.struct(path(name, index, c).alias("path"), F.when(v.isNull(), C.NULL).otherwise(tag).alias("tag"), F.when(v.isNull(), "null").otherwise(C.TAG_KINDS[tag]).alias("json_kind"), v.cast("string").alias("literal")) for c, (tag, v) in columns.items()]
    return rows.select(record_id.cast("string").alias("record_id"), F.inline(F.array(*items)))
