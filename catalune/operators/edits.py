"""Bulk edits as pure functions of frames and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fill_if_empty(value: Column, found: Column, edited: Column) -> Column:
    """Only what is empty and wasn't edited by hand is filled."""
    return F.when((F.coalesce(value, F.lit("")) == "") & ~edited, found).otherwise(value)


def pick_field(frames: Column, names: list[str]) -> Column:
    """The first non-empty of named entries of a map, in the order of names, whatever their case."""
    low = F.transform_keys(frames, lambda k, _: F.lower(k))
    return F.coalesce(*(F.nullif(F.trim(F.element_at(low, F.lit(n.lower()))), F.lit("")) for n in names))


def numbered(df: DataFrame, same: list[str], order: list[str], name: str) -> DataFrame:
    """Numbers rows that share values, from 1."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*same).orderBy(*order)))


def first_name(file: Column) -> Column:
    """A file name without " (n)" before its extension."""
    return F.regexp_replace(file, r" \(\d+\)(\.[^.]*)?$", "$1")


def set_key(json: Column, key: str, value: Column) -> Column:
    """A flat JSON object with a key set; value is JSON text. Keys keep their order, a new one is the last."""
    entries = F.map_filter(F.from_json(json, "map<string,string>"), lambda k, _: k != key)
    parts = F.transform(F.map_entries(entries), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
    return F.concat(F.lit("{"), F.array_join(F.concat(parts, F.array(F.concat(F.lit(f'"{key}":'), value))), ","), F.lit("}"))


def same_json(a: Column, b: Column) -> Column:
    """Equal whatever the order of keys (of one level)."""
    flat = lambda c: F.array_sort(F.map_entries(F.from_json(c, "map<string,string>")))
    return flat(a) == flat(b)


def both_merged(local: Column, remote: Column) -> Column:
    """Two lists joined, the remote's new entries last; or two texts, one line each unless one holds the other."""
    return F.array_union(local, remote)


def rate(df: DataFrame, chosen: Column, rating: float | None, col: str = "rating") -> DataFrame:
    """Half stars, 0.5 to 5; null clears."""
    value = None if rating is None else min(5.0, max(0.5, int(rating * 2 + 0.5) / 2))
    return df.withColumn(col, F.when(chosen, F.lit(value).cast("double")).otherwise(F.col(col)))


def set_info(df: DataFrame, chosen: Column, patch: dict[str, object], edited: str = "edited") -> DataFrame:
    """Sets fields of the chosen rows and notes which were changed."""
    changed = F.array(*map(F.lit, patch))
    return df.withColumns({k: F.when(chosen, F.lit(v)).otherwise(F.col(k)) for k, v in patch.items()} | {edited: F.when(chosen, F.array_union(edited, changed)).otherwise(F.col(edited))})


def rename_tag(df: DataFrame, old: str, new: str, col: str = "tags") -> DataFrame:
    """A tag under another name; where both are there, one stays."""
    from catalune.functions.text import unique_tags

    return df.withColumn(col, F.when(F.exists(col, lambda t: F.lower(t) == old.lower()), unique_tags(F.transform(col, lambda t: F.when(F.lower(t) == old.lower(), new).otherwise(t)))).otherwise(F.col(col)))


def insert_at(items: Column, new: Column, at: Column) -> Column:
    """New items put in at a place (from 0), moved there if the list had them."""
    rest = lambda part: F.filter(part, lambda x: ~F.array_contains(new, x))
    return F.concat(rest(F.slice(items, F.lit(1), at)), new, rest(F.slice(items, at + 1, F.greatest(F.size(items), F.lit(1)))))


def exclusive(df: DataFrame, id_col: str, chosen: Column, flag: str) -> DataFrame:
    """Exactly the chosen row has the flag."""
    return df.withColumn(flag, F.col(id_col).eqNullSafe(chosen))
