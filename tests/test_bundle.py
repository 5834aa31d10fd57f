"""Bundles go out and come back whole; feature weights are clamped."""

from pyspark.sql import functions as F

from palate.sources import bundle


def test_bundle_round_trip(spark, tmp_path):
    films = spark.createDataFrame([("a", "A", ["x", "y"]), ("b", None, None)], "slug string, title string, genres array<string>")
    inter = spark.createDataFrame([("u", "a", 4.5, True), ("u", "b", None, False)], "username string, slug string, rating double, liked boolean")
    bundle.export_bundle(films, inter, str(tmp_path), F.lit("2024-01-01"))
    f, i = bundle.import_bundle(spark, str(tmp_path), films.schema, inter.schema)
    assert sorted(map(str, f.collect())) == sorted(map(str, films.collect())) and sorted(map(str, i.collect())) == sorted(map(str, inter.collect()))
    assert spark.read.json(f"{tmp_path}/manifest").first()["n_interactions"] == 2


def test_feature_weights(spark):
    df = spark.createDataFrame([('{"genre": {"horror": 9, "drama": "bad"}, "decade": {"1990": 0.01}}',), ("not json",)], "value string")
    got = {(r["attr_type"], r["key"]): r["factor"] for r in bundle.feature_weights(df).collect()}
    assert got == {("genre", "horror"): 3.0, ("genre", "drama"): 1.0, ("decade", "1990"): 0.2}


def test_weights_go_out_and_come_back(spark, tmp_path):
    df = spark.createDataFrame([("genre", "noir", 1.5), ("director", "R", 99.0), ("decade", "1970", 0.5)], "attr_type string, key string, factor double")
    bundle.write_feature_weights(df, str(tmp_path / "w"))
    got = {(r["attr_type"], r["key"]): r["factor"] for r in bundle.feature_weights(spark.read.text(str(tmp_path / "w"))).collect()}
    assert got == {("genre", "noir"): 1.5, ("director", "R"): 3.0, ("decade", "1970"): 0.5}


def test_bundles_merge_over_what_is_there(spark):
    films = spark.createDataFrame([("a", "Old"), ("c", "C")], "slug string, title string")
    inter = spark.createDataFrame([("u", "a", 1.0, "2020"), ("w", "a", 2.0, "2020")], "username string, slug string, rating double, scraped_at string")
    attrs = spark.createDataFrame([("a", "genre", "gone", 1), ("c", "genre", "kept", 1)], "slug string, attr_type string, attr_value string, pos int")
    new_films = spark.createDataFrame([("a", "New", ["noir"]), ("b", "B", None)], "slug string, title string, genres array<string>")
    new_inter = spark.createDataFrame([("u", "a", 5.0, "2019"), ("u", "b", 3.0, "2021")], inter.schema)
    f, i, at, idf = bundle.merge_bundle(films, inter, attrs, new_films, new_inter, {"genre": "genres"})
    assert sorted(map(tuple, f.collect())) == [("a", "New"), ("b", "B"), ("c", "C")]
    assert sorted((r["username"], r["slug"], r["rating"]) for r in i.collect()) == [("u", "a", 5.0), ("u", "b", 3.0), ("w", "a", 2.0)]
    assert sorted((r["slug"], r["attr_value"]) for r in at.collect()) == [("a", "noir"), ("c", "kept")]
    assert {r["attr_value"] for r in idf.collect()} == {"noir", "kept"}
