"""Facts about qualified names and ids, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT_KINDS = {
    "function_declaration": "function", "method_declaration": "method", "constructor_declaration": "constructor",
    "compact_constructor_declaration": "constructor", "class_declaration": "class", "interface_declaration": "interface",
    "enum_declaration": "enum", "record_declaration": "record", "lambda_expression": "lambda",
    "object_creation_expression": "anonymous_class",
}
JAVA_TYPE_KINDS = ["class_declaration", "interface_declaration", "enum_declaration", "record_declaration"]


def symbol_id(path: Column, name: Column) -> Column:
    return F.concat(path, F.lit("::"), name)


def id_path(symbol: Column) -> Column:
    return F.substring_index(symbol, "::", 1)


def short_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def package(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def node_kind(name: Column) -> Column:
    """By the number of dots alone, so that a class in a dotted package reads as a method, too."""
    dots = F.length(name) - F.length(F.replace(name, F.lit("."), F.lit("")))
    return F.when(dots >= 2, "method").otherwise("function")


def context_kind(kind: Column, name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CONTEXT_KINDS.items() for x in pair])
    return F.coalesce(known[kind], node_kind(name))


def callable_name(name: Column) -> Column:
    """Without the first segment; the whole name if it has one segment."""
    return F.when(name.contains("."), F.regexp_replace(name, r"^[^.]*\.", "")).otherwise(name)
