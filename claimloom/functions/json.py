"""JSON objects held in string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_map(c: Column) -> Column:
    """The object as a map of its fields; an empty map for null and for what is no JSON object."""
    ok = F.when(F.try_parse_json(c).isNotNull() & c.rlike(r"^\s*\{"), c)
    return F.coalesce(F.from_json(ok, "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))


def merged(base: Column, patch: Column) -> Column:
    """``base`` updated by the fields of ``patch``, both JSON objects in strings; null where neither has a field."""
    new = as_map(patch)
    old = F.map_filter(as_map(base), lambda k, v: ~F.map_contains_key(new, k))
    both = F.map_concat(old, new)
    return F.when(F.size(both) > 0, F.to_json(both))


def strings(c: Column, field: str) -> Column:
    """A field of the object as an array of strings, empty if it is missing."""
    return F.coalesce(F.from_json(F.get_json_object(c, f"$.{field}"), "array<string>"), F.array().cast("array<string>"))
