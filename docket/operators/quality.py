"""Checks of the shape of responses, in one pass each: what is there, what is missing, and whether asking again could help."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREVIEW, SHOWN = 160, 14


def json_kind(body: Column) -> Column:
    """OBJECT, ARRAY or the kind of another JSON value; null for what isn't JSON."""
    return F.regexp_extract(F.schema_of_variant(F.try_parse_json(body)), r"^[A-Z]+", 0)


def cut_off(body: Column) -> Column:
    """Not JSON, but it begins like it: probably cut off on the way."""
    return F.try_parse_json(body).isNull() & F.ltrim(body).rlike(r"^[{\[]")


def preview(body: Column) -> Column:
    """The start of a body on one line."""
    return F.substring(F.trim(F.regexp_replace(body, r"\s+", " ")), 1, PREVIEW)


def list_shape(df: DataFrame, body: str, key: str, allow_empty: bool = True) -> DataFrame:
    """df with ok, transient and note: whether the JSON holds a list under key."""
    raw = F.get_json_object(body, f"$.{key}")
    listed = F.coalesce(json_kind(raw) == "ARRAY", F.lit(False))
    size = F.json_array_length(raw)
    parsed = F.try_parse_json(F.col(body)).isNotNull()
    first = F.slice(F.coalesce(F.json_object_keys(F.get_json_object(body, f"$.{key}[0]")), F.array().cast("array<string>")), 1, SHOWN)
    note = F.when(~parsed, preview(F.col(body))).when(~listed, "no list under the key").otherwise(F.concat(size.cast("string"), F.lit(" records; "), F.array_join(first, ", ")))
    ok = listed & (F.lit(allow_empty) | (size > 0))
    return df.withColumns({"ok": F.coalesce(ok, F.lit(False)), "transient": F.coalesce(cut_off(F.col(body)), F.lit(False)), "note": note})


def record_shape(df: DataFrame, body: str, fields: tuple[str, ...], inner: tuple[str, ...] = ("data",)) -> DataFrame:
    """df with ok, transient, missing, place, and the longest text of the record there with its length: whether an object at the root, or one level down under one of inner, holds all
    fields."""
    need = F.array(*[F.lit(f) for f in fields])
    lacking = lambda keys: F.array_except(need, F.coalesce(keys, F.array().cast("array<string>")))
    spots = [("$", lacking(F.json_object_keys(body)))] + [(f"$.{k}", lacking(F.json_object_keys(F.get_json_object(body, f"$.{k}")))) for k in inner]
    place = F.coalesce(*[F.when(F.size(m) == 0, F.lit(p)) for p, m in spots])
    missing = F.when(place.isNotNull(), F.array().cast("array<string>")).otherwise(spots[0][1])
    value = F.try_parse_json(F.col(body))
    held = F.when(place == "$", F.try_variant_get(value, "$", "map<string,variant>"))
    for k in inner:
        held = F.when(place == f"$.{k}", F.try_variant_get(value, f"$.{k}", "map<string,variant>")).otherwise(held)
    texts = F.filter(F.map_entries(held), lambda e: F.schema_of_variant(e["value"]) == "STRING")
    longest = F.array_max(F.transform(texts, lambda e: F.named_struct(F.lit("n"), F.length(F.try_variant_get(e["value"], "$", "string")), F.lit("name"), e["key"])))
    out = {"ok": place.isNotNull(), "transient": F.coalesce(cut_off(F.col(body)), F.lit(False)), "missing": missing, "place": place}
    return df.withColumns(out | {"longest": longest["name"], "longest_chars": longest["n"]})


def html_shape(df: DataFrame, html: str, fragments: tuple[str, ...]) -> DataFrame:
    """df with ok and missing: fragments that a page lacks, whatever their case."""
    low = F.lower(F.coalesce(html, F.lit("")))
    missing = F.filter(F.array(*[F.when(~F.contains(low, F.lit(f.lower())), f) for f in fragments]), lambda f: f.isNotNull())
    return df.withColumns({"ok": F.size(missing) == 0, "missing": missing})


def marker_counts(df: DataFrame, key: str, body: str, markers: tuple[str, ...]) -> DataFrame:
    """key, marker, n: occurrences of each marker; none is a result too."""
    low = F.lower(F.coalesce(body, F.lit("")))
    each = [F.struct(F.lit(m).alias("marker"), ((F.length(low) - F.length(F.replace(low, F.lit(m.lower()), F.lit("")))) / len(m)).cast("long").alias("n")) for m in markers]
    return df.select(key, F.inline(F.array(*each)))
