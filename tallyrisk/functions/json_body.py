"""Request bodies (JSON text) to feature maps, key lists and hashes, on the VARIANT type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_NUMBER_MAP = "map<string,double>"


def parsed(body: Column | str) -> Column:
    return F.try_parse_json(F.col(body) if isinstance(body, str) else body)


def starts_with(body: Column) -> Column:
    """First character of the JSON text: it tells the kind of a valid JSON value."""
    return F.substring(F.btrim(body, F.lit(" \t\r\n")), 1, 1)


def is_object(body: Column) -> Column:
    """The text is a JSON object. The first character decides cheaply, then the text must parse."""
    return F.coalesce((starts_with(body) == "{") & parsed(body).isNotNull(), F.lit(False))


def cells(variant: Column, path: str = "$") -> Column:
    """The object at a path as a map of its members, sorted by key; null if there is no object."""
    return F.try_variant_get(variant, path, "map<string,variant>")


def feature_map(variant: Column, limit: int | None = None, own: Column | None = None) -> Column:
    """Numbers and booleans (as 0/1) of the nested ``features`` object, or of the body itself.
    Text, nulls, lists and nested objects are left out. Anything but an object gives an empty map.
    A limit, if asked for, keeps the first features in key order."""
    entries = F.map_entries(F.coalesce(cells(variant, "$.features"), cells(variant) if own is None else own))
    named = F.transform(
        entries,
        lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.schema_of_variant(e["value"]).alias("kind")),
    )
    plain = ["BOOLEAN", "BIGINT", "DOUBLE", "FLOAT"]
    numeric = F.filter(named, lambda e: e["kind"].isin(plain) | F.startswith(e["kind"], F.lit("DECIMAL")))
    typed = F.transform(
        numeric, lambda e: F.struct(e["key"].alias("key"), F.try_variant_get(e["value"], "$", "double").alias("value"))
    )
    # The entries of an object arrive sorted by key.
    return F.coalesce(F.map_from_entries(typed if limit is None else F.slice(typed, 1, limit)), F.create_map().cast(_NUMBER_MAP))


def sorted_keys(body: Column) -> Column:
    """Sorted top-level keys; null unless the body is an object."""
    return F.array_sort(F.json_object_keys(body))


def payload_hash(body: Column, variant: Column | None = None) -> Column:
    """SHA-256 of the key-sorted JSON text. Other JSON values are hashed by their type name,
    unreadable text by the whole text."""
    variant = parsed(body) if variant is None else variant
    first = starts_with(body)
    kind_name = (
        F.when(first == "[", "list")
        .when(first == '"', "str")
        .when(first.isin("t", "f"), "bool")
        .when(first == "n", "NoneType")
        .when(body.rlike("[.eE]"), "float")
        .otherwise("int")
    )
    text = (
        F.when(variant.isNull(), F.to_json(F.struct(body.alias("raw_payload"))))
        .when(first == "{", F.to_json(variant))
        .otherwise(F.to_json(F.struct(kind_name.alias("payload_type"))))
    )
    return F.when(F.length(F.coalesce(body, F.lit(""))) > 0, F.sha2(text, 256))


def with_body_columns(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``payload_hash``, ``payload_keys`` and ``input_features`` for a body column. The body is
    parsed once per row."""
    text = F.col(body)
    variant, own = F.col("__variant"), F.col("__own")
    once = df.withColumn("__variant", parsed(text)).withColumn("__own", cells(variant))
    added = {
        "payload_hash": payload_hash(text, variant),
        "payload_keys": F.array_sort(F.map_keys(own)),
        "input_features": feature_map(variant, own=own),
    }
    return once.withColumns(added).drop("__variant", "__own")


def features_long(df: DataFrame, keys: list[str], features: str = "input_features") -> DataFrame:
    """One row per (keys, feature) with a number; empty maps vanish."""
    long = df.select(*keys, F.explode(features).alias("feature", "value"))
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def features_wide(df: DataFrame, keys: list[str], names: list[str], features: str = "input_features") -> DataFrame:
    """One column per feature name; rows without any feature vanish, absent features are null."""
    kept = df.where(F.size(F.coalesce(F.col(features), F.create_map().cast(_NUMBER_MAP))) > 0)
    return kept.select(*keys, *[F.try_element_at(F.col(features), F.lit(n)).alias(n) for n in names])


def feature_vocabulary(df: DataFrame, features: str = "input_features") -> DataFrame:
    return df.select(F.explode(F.map_keys(features)).alias("feature")).distinct()
