"""Arrays and maps as sets and dictionaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dedup(a: Column) -> Column:
    """Distinct elements in rising order."""
    return F.array_sort(F.array_distinct(a))


def contains(a: Column, x: Column) -> Column:
    return F.array_contains(a, x)


def contains_any(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def contains_all(a: Column, b: Column) -> Column:
    """Every element of b is in a."""
    return F.size(F.array_except(b, a)) == 0


def same_elements(a: Column, b: Column) -> Column:
    """Equal as multisets."""
    return F.array_sort(a) == F.array_sort(b)


def as_uint64(a: Column) -> Column:
    """Any numbers as BIGINT."""
    return F.transform(a, lambda x: x.cast("bigint"))


def show_set(a: Column, most: int = 0x40000) -> Column:
    """Text {1,2,...}, shortened behind `most` elements."""
    texts = F.transform(F.slice(a, 1, most), lambda x: x.cast("string"))
    tail = F.when(F.size(a) > most, F.lit(",...")).otherwise(F.lit(""))
    return F.concat(F.lit("{"), F.array_join(texts, ","), tail, F.lit("}"))


def put(m: Column, key: Column, value: Column) -> Column:
    """struct<map, prev, updated>: the map with key set to value, the value before and whether there was one."""
    others = F.map_filter(m, lambda k, _: k != key)
    return F.struct(F.map_concat(others, F.create_map(key, value)).alias("map"), F.try_element_at(m, key).alias("prev"), F.map_contains_key(m, key).alias("updated"))


def drop_key(m: Column, key: Column) -> Column:
    """struct<map, prev, ok>: the map without key, the value before and whether there was one."""
    return F.struct(F.map_filter(m, lambda k, _: k != key).alias("map"), F.try_element_at(m, key).alias("prev"), F.map_contains_key(m, key).alias("ok"))


def find(m: Column, key: Column) -> Column:
    """struct<value, exists>."""
    return F.struct(F.try_element_at(m, key).alias("value"), F.map_contains_key(m, key).alias("exists"))


def get(m: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(m, key), default)


def merge(into: Column, other: Column) -> Column:
    """All entries of both; of equal keys the other's."""
    kept = F.map_filter(into, lambda k, _: ~F.coalesce(F.map_contains_key(other, k), F.lit(False)))
    return F.map_concat(kept, other)


def update_values(m: Column, f) -> Column:
    return F.transform_values(m, f)


def show_map(m: Column) -> Column:
    """Text {k: v, ...} in order of keys."""
    entries = F.array_sort(F.map_entries(m))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit(": "), e["value"].cast("string"))), ", "), F.lit("}"))


def new_map(keys: Column, values: Column) -> Column:
    """A map of arrays of keys and values; of equal keys the last value counts."""
    entries = F.arrays_zip(keys.alias("k"), values.alias("v"))
    empty = F.map_from_arrays(F.slice(keys, 1, 0), F.slice(values, 1, 0))
    return F.aggregate(entries, empty, lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.map_from_arrays(F.array(e["k"]), F.array(e["v"]))))


def clear(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: F.lit(False))


def map_keys(m: Column) -> Column:
    """Keys in rising order."""
    return F.array_sort(F.map_keys(m))


def map_values(m: Column) -> Column:
    """Values in the order of their keys."""
    return F.transform(F.array_sort(F.map_entries(m)), lambda e: e["value"])


def first_entry(m: Column) -> Column:
    """struct<key, value> of the least key; null for an empty map."""
    return F.try_element_at(F.array_sort(F.map_entries(m)), F.lit(1))


def next_entry(m: Column, key: Column) -> Column:
    """struct<key, value> of the least key above the given one; null behind the last."""
    return F.try_element_at(F.filter(F.array_sort(F.map_entries(m)), lambda e: e["key"] > key), F.lit(1))
