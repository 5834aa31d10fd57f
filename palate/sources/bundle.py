"""Bundles of films and interactions as JSON, and feature-weight files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palate.operators.catalogue import attribute_idf, normalize_attrs, replace_attrs, upsert_latest

#: Factors for single values stay within these bounds; anything unreadable counts as 1.
LEAST_FACTOR, MOST_FACTOR = 0.2, 3.0


def export_bundle(films: DataFrame, inter: DataFrame, path: str, exported_at) -> None:
    """A directory of JSON lines for each table and one for the manifest."""
    films.write.mode("overwrite").json(f"{path}/films")
    inter.write.mode("overwrite").json(f"{path}/interactions")
    size = films.agg(F.count("*").alias("n_films")).crossJoin(inter.agg(F.count("*").alias("n_interactions")))
    size.withColumn("exported_at", exported_at).write.mode("overwrite").json(f"{path}/manifest")


def import_bundle(spark: SparkSession, path: str, films_schema, inter_schema) -> tuple[DataFrame, DataFrame]:
    """(films, interactions) of a bundle, typed by the given schemas; lines that aren't JSON are dropped."""
    read = lambda name, schema: spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{path}/{name}")
    return read("films", films_schema), read("interactions", inter_schema)


def merge_bundle(films: DataFrame, inter: DataFrame, attrs: DataFrame, new_films: DataFrame, new_inter: DataFrame, columns: dict[str, str]):
    """(films, interactions, attributes, idf): a bundle's rows over those that are there, its films' attributes replaced, the idf anew.

    columns: the array column of new_films for each kind of attribute."""
    plain = [c for c in new_films.columns if c not in columns.values()]
    films = upsert_latest(films.select(*plain), new_films.select(*plain), ["slug"], [])
    inter = upsert_latest(inter, new_inter.select(*inter.columns), ["username", "slug"], ["scraped_at"])
    attrs = replace_attrs(attrs, normalize_attrs(new_films, columns))
    return films, inter, attrs, attribute_idf(attrs, films)


def write_feature_weights(weights: DataFrame, path: str) -> None:
    """One JSON object of maps by kind, clamped, that feature_weights() reads."""
    clamped = F.greatest(F.least("factor", F.lit(MOST_FACTOR)), F.lit(LEAST_FACTOR))
    maps = weights.groupBy("attr_type").agg(F.map_from_entries(F.collect_list(F.struct("key", clamped.cast("string").alias("factor")))).alias("m"))
    whole = maps.agg(F.map_from_entries(F.collect_list(F.struct("attr_type", "m"))).alias("m"))
    whole.select(F.to_json("m").alias("value")).write.mode("overwrite").text(path)


def feature_weights(files: DataFrame, column: str = "value") -> DataFrame:
    """(attr_type, key, factor) from JSON objects of genre, director and decade maps, clamped."""
    kinds = ("genre", "director", "decade")
    parsed = files.select(F.from_json(column, "struct<" + ",".join(f"{k}: map<string, string>" for k in kinds) + ">").alias("w"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("attr_type"), F.col(f"w.{k}").alias("m")) for k in kinds]))
    long = parsed.select(rows.alias("r")).select("r.attr_type", F.explode("r.m").alias("key", "text"))
    number = F.col("text").try_cast("double")
    factor = F.when(number.isNull(), 1.0).otherwise(F.greatest(F.least(number, F.lit(MOST_FACTOR)), F.lit(LEAST_FACTOR)))
    return long.select("attr_type", "key", factor.alias("factor"))
