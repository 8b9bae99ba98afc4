"""Structured records: leaves are protected like documents, with the nearest key as the field that column rules see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.operators.context import KEY_CLASSES


def leaves(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, field_name and text of every string column; numbers, booleans and nulls are never rewritten."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("text")) for c in columns))
    return rows.select(key, F.explode(pairs).alias("e")).select(key, "e.field_name", "e.text").where("text IS NOT NULL")


def assemble(rows: DataFrame, done: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with the columns replaced by ``done`` (key, field_name, clean_text): one aggregation, one join."""
    wide = done.groupBy(key).agg(*(F.max(F.when(F.col("field_name") == c, F.col("clean_text"))).alias(f"__{c}") for c in columns))
    return rows.join(wide, key, "left").select(*(F.col(f"__{c}").alias(c) if c in columns else F.col(c) for c in rows.columns))


def field_class(name):
    """Class that a record's key names, by its letters and digits alone."""
    key = F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))
    out = F.lit(None).cast("string")
    for cls, keys in KEY_CLASSES.items():
        out = F.when(key.isin(keys.split()), cls).otherwise(out)
    return out
