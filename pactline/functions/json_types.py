"""JSON type names and canonical text of VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The seven JSON type names, in the order they are listed to a reader.
JSON_TYPES = ("array", "boolean", "integer", "null", "number", "object", "string")

_BY_PREFIX = (
    "map('OBJ','object','ARR','array','STR','string','BIG','integer',"
    "'BOO','boolean','VOI','null','DOU','number','FLO','number')"
)


def type_sql(v: str) -> str:
    """SQL text naming the JSON type of VARIANT expression `v`.

    Integers are values an i64 or a u64 holds; the latter parse as DECIMAL(19..20,0).
    Containers are told by a cast: their schema merges those of all elements, which is quadratic in the members.
    """
    return (
        f"CASE WHEN try_variant_get({v}, '$', 'map<string,variant>') IS NOT NULL THEN 'object'"
        f" WHEN try_variant_get({v}, '$', 'array<variant>') IS NOT NULL THEN 'array' ELSE "
        f"coalesce(element_at({_BY_PREFIX}, left(schema_of_variant({v}), 3)),"
        f" if(schema_of_variant({v}) RLIKE '^DECIMAL[(](19|20),0[)]$', 'integer', 'number')) END"
    )


def json_type(col: str) -> Column:
    """Column form of `type_sql` for a column name."""
    return F.expr(type_sql(col))


def blank_sql(v: str, type_name: str) -> str:
    """SQL text: the value is a string holding nothing but white space."""
    return f"({type_name} = 'string' AND try_variant_get({v}, '$', 'string') RLIKE '(?U)^\\\\s*$')"


def json_text(col: Column) -> Column:
    """The string a JSON string literal stands for; other JSON text unchanged."""
    unquoted = F.get_json_object(F.concat(F.lit('{"v":'), col, F.lit("}")), "$.v")
    return F.when(col.startswith('"'), unquoted).otherwise(col)
