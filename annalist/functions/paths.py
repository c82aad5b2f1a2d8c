"""Paths into JSON text, compiled to one expression each: keys, numbers of a list's items, and ``*`` for all items of a list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annalist.functions.rules import kind_of


def _member(v: Column, name: str) -> Column:
    quote = '"' if "'" in name else "'"
    return F.try_variant_get(v, f"$[{quote}{name}{quote}]", "variant")


def compiled(v: Column, parts: list[str]) -> Column:
    """What the parts lead to, as JSON text; null if there is nothing.  Of all items of a list there is something only if
    there is of each."""
    if not parts:
        return F.to_json(v)
    head, *tail = parts
    out = F.when(kind_of(v) == "OBJECT", compiled(_member(v, head), tail))
    if head == "*":
        each = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: compiled(x, tail))
        whole = F.when(~F.exists(each, lambda x: x.isNull()), F.concat(F.lit("["), F.array_join(each, ","), F.lit("]")))
        out = out.when(kind_of(v) == "ARRAY", whole)
    elif head.isdecimal():
        out = out.when(kind_of(v) == "ARRAY", compiled(F.try_variant_get(v, f"$[{int(head)}]", "variant"), tail))
    return out


def at(json: Column, path: str) -> Column:
    """The value at a path like ``messages.*.role`` or ``items.0``, as JSON text.  Parts are what stands between the dots; a key
    with both kinds of quotes can't be named."""
    return compiled(F.try_parse_json(json), path.split(".") if path else [])


def read(json: Column, paths: dict[str, str]) -> list[Column]:
    """Columns by name for many paths: one scan, the text is parsed once."""
    return [at(json, path).alias(name) for name, path in paths.items()]
