"""Type names and lengths of JSON values held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineseek.functions.numbers import number_text_length
from lineseek.functions.text import utf16_length
from lineseek.session import let


def kind_of(value: Column) -> Column:
    """Spark's own schema text of a variant; its head tells the JSON type."""
    return F.schema_of_variant(value)


def string_of(value: Column, kind: Column) -> Column:
    """The text of a JSON string, null for any other type."""
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))


def array_head(value: Column, kind: Column) -> Column:
    """JSON text of element 0 of an array; null for an empty array or another type.

    A number too large for a double is printed as ``"Infinity"``; where the text of the
    innermost first element is that, its own type tells the number from the string.
    """

    def told_apart(text: Column) -> Column:
        depth = F.length(F.regexp_extract(text, r"^\[*", 0))
        innermost = F.variant_get(value, F.concat(F.lit("$"), F.repeat(F.lit("[0]"), depth + 1)), "variant")
        number = text.rlike(r'^\[*"-?Infinity"') & (kind_of(innermost) != "STRING")
        return F.when(number, F.regexp_replace(text, '"(-?Infinity)"', "$1")).otherwise(text)

    return F.when(kind.startswith("ARRAY"), let(F.to_json(F.variant_get(value, "$[0]", "variant")), told_apart))


def array_type(head: Column) -> Column:
    """``array_of_<type of element 0>`` from ``array_head``, at any nesting depth.

    The leading brackets of the text give the depth and the character after them
    the innermost type. (``schema_of_variant`` would merge all elements.)
    """
    depth = F.length(F.regexp_extract(head, r"^\[*", 0))
    mark = F.regexp_extract(head, r"^\[*(.)", 1)
    inner = (
        F.when(mark == '"', "array_of_string")
        .when(mark == "{", "array_of_object")
        .when(mark.isin("t", "f"), "array_of_boolean")
        .when(mark == "n", "array_of_null")
        .when(mark == "]", "empty_array")
        .otherwise("array_of_number")
    )
    return F.concat(F.repeat(F.lit("array_of_"), depth), inner)


def value_type(kind: Column, head: Column) -> Column:
    """``null``, ``string``, ``number``, ``boolean``, ``object``, ``empty_array``
    or ``array_of_<type>``."""
    return (
        F.when(kind == "STRING", "string")
        .when(kind == "VOID", "null")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), F.coalesce(array_type(head), F.lit("empty_array")))
        .when(kind.isNotNull(), "number")
    )


def value_length(value: Column, kind: Column, text: Column) -> Column:
    """String length, element count, key count, or length of the printed scalar;
    ``text`` is ``string_of`` the value."""
    return (
        F.when(kind == "STRING", utf16_length(text))
        .when(kind == "VOID", 0)
        .when(kind == "BOOLEAN", F.length(F.try_variant_get(value, "$", "string")))
        .when(kind.startswith("OBJECT"), F.size(F.try_variant_get(value, "$", "map<string,variant>")))
        .when(kind.startswith("ARRAY"), F.size(F.try_variant_get(value, "$", "array<variant>")))
        .when(kind.isNotNull(), number_text_length(F.try_variant_get(value, "$", "double")))
        .cast("bigint")
    )


def is_falsy(value: Column, kind: Column) -> Column:
    """Missing, null, empty string, zero or false."""
    return (
        F.when(value.isNull() | (kind == "VOID"), True)
        .when(kind == "STRING", F.try_variant_get(value, "$", "string") == "")
        .when(kind == "BOOLEAN", ~F.try_variant_get(value, "$", "boolean"))
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), False)
        .otherwise(F.try_variant_get(value, "$", "double") == 0)
    )


def field_path(name: str) -> str:
    """Variant path of a top-level key with any name."""
    if "'" not in name:
        return f"$['{name}']"
    if '"' not in name:
        return f'$["{name}"]'
    raise ValueError(f"field name mixes both quote marks: {name}")
