"""Algebra of attribute maps (MAP<STRING,STRING>), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def get(m: Column, key: str, default=None) -> Column:
    """The stored value, null included; the default only where the key is absent."""
    return F.when(F.map_contains_key(m, key), F.element_at(m, key)).otherwise(F.lit(default))


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def union(a: Column, b: Column) -> Column:
    """All keys; the first value stays unless it is blank; unlike values become a JSON list of both."""
    return F.map_zip_with(a, b, lambda k, x, y: F.when(_blank(x), F.coalesce(y, x)).when(_blank(y) | (x == y), x).otherwise(F.to_json(F.array(x, y))))


def intersection(a: Column, b: Column) -> Column:
    """Common keys; unlike values become a JSON list of both."""
    common = F.map_filter(a, lambda k, v: F.map_contains_key(b, k))
    return F.map_zip_with(common, F.map_filter(b, lambda k, v: F.map_contains_key(a, k)), lambda k, x, y: F.when(x.eqNullSafe(y), x).otherwise(F.to_json(F.array(x, y))))


def difference(a: Column, b: Column) -> Column:
    return F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.map_concat(difference(a, b), difference(b, a))


def impose(a: Column, b: Column) -> Column:
    """b's values override a's."""
    return F.map_concat(difference(a, b), b)


def imprint(a: Column, b: Column) -> Column:
    """a's keys alone, with b's values where b has them."""
    return F.transform_values(a, lambda k, v: F.when(F.map_contains_key(b, k), F.element_at(b, k)).otherwise(v))


def remove_key(m: Column, key: str, case_sensitive: bool = False) -> Column:
    return F.map_filter(m, lambda k, v: (k != key) if case_sensitive else (F.lower(k) != key.lower()))


def one_hot(m: Column, key: str, categories: list[str]) -> Column:
    """Without the key, with ``key_i`` "1" or "0" for each category."""
    flags = [x for i, c in enumerate(categories) for x in (F.lit(f"{key}_{i}"), F.when(F.element_at(m, key).eqNullSafe(F.lit(c)), F.lit("1")).otherwise(F.lit("0")))]
    return F.map_concat(F.map_filter(m, lambda k, v: k != key), F.create_map(*flags))


def matches(m: Column, key: str, kind: str, value: str | None) -> Column:
    """One of nine searches in a key's value; a blank search keeps all, ``*`` stands for any text, an absent key fails."""
    if value is None or value == "":
        return F.lit(True)
    c, v = F.element_at(m, key), value.replace("*", ".+")
    low, want = F.lower(c), v.lower()
    kinds = {
        "any": F.map_contains_key(m, key), "equal to": low == want, "not equal to": low != want, "contains": low.contains(want),
        "does not contain": ~low.contains(want), "starts with": low.startswith(want), "does not start with": ~low.startswith(want),
        "ends with": low.endswith(want), "does not end with": ~low.endswith(want),
    }
    return F.coalesce(kinds[kind], F.lit(False))


def cluster_key(m: Column, keys: list[str]) -> Column:
    """The non-null values of the keys as JSON; ``_NONE_`` for an empty map."""
    return F.when(F.size(m) == 0, F.lit("_NONE_")).otherwise(F.to_json(F.array_compact(F.array(*[F.element_at(m, k) for k in keys]))))


def canonical(m: Column) -> Column:
    """A scalar form: sorted ``key=value`` entries."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ";")


def keys_at_value(m: Column, value: str) -> Column:
    return F.map_keys(F.map_filter(m, lambda k, v: v == value))


def values_at(m: Column, keys: list[str], default=None) -> Column:
    return F.array(*[get(m, k, default) for k in keys])


def set_values(m: Column, keys: list[str], values: list[Column]) -> Column:
    """Creates or replaces several entries."""
    return impose(m, F.create_map(*[x for k, v in zip(keys, values) for x in (F.lit(k), v.cast("string"))]))
