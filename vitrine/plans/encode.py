"""Canonical flat text for nested columns, for engine-independent comparison.

Arrays of scalars become their elements joined by ``|``; arrays of structs
become each element's fields (as text) joined by ``:``, elements joined by
``|``; a struct column becomes one column per field (``<col>_<field>``). The
same encoding is written in the oracle SQL, so two engines' results compare
row by row without depending on how each client library renders nested values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fields_text(st: T.StructType):
    names = [x.name for x in st.fields]

    def text(x):
        return F.concat_ws(":", *[x[n].cast("string") for n in names])
    return text


def encode_nested(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        t = f.dataType
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
            cols.append(F.array_join(F.transform(c, _fields_text(t.elementType)), "|")
                        .alias(f.name))
        elif isinstance(t, T.ArrayType):
            cols.append(F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(f.name))
        elif isinstance(t, T.StructType):
            cols += [c[x.name].alias(f"{f.name}_{x.name}") for x in t.fields]
        else:
            cols.append(c)
    return df.select(*cols)


def sql_array(col: str) -> str:
    return f"array_to_string({col}, '|') AS {col}"


def sql_struct_array(col: str, fields: list[str]) -> str:
    inner = ", ".join(f"CAST(x.{f} AS VARCHAR)" for f in fields)
    return f"array_to_string(list_transform({col}, lambda x: concat_ws(':', {inner})), '|') AS {col}"


def sql_struct(col: str, fields: list[str]) -> str:
    return ", ".join(f"{col}.{f} AS {col}_{f}" for f in fields)
