"""Taste profiles of all users: long tables of attribute scores, pairs, interactions, momentum and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palate.functions import weights as W

# Fixed values of the taste model: how deep lists count, scales, and the exponent that dampens counts.
DEPTH = {"actor": 5, "theme": 10}
SCALE = {"actor": 0.7, "theme": 0.5}
LATER_COUNTRY = 0.3
EXPONENT, ACTOR_EXPONENT = 0.5, 0.3


def rating_stats(inter: DataFrame) -> DataFrame:
    """(username, mean, deviation, n_ratings). Rounded to 9 digits, so that no order of sums shows."""
    rated = inter.filter("rating is not null").groupBy("username")
    mean, deviation = F.round(F.avg("rating"), 9), F.round(F.stddev_pop("rating"), 9)
    return rated.agg(mean.alias("mean"), deviation.alias("deviation"), F.count("*").alias("n_ratings"))


def with_base_weight(inter: DataFrame, mode: str = "absolute") -> DataFrame:
    """inter with `base`, by mode absolute, normalized or blended."""
    if mode == "absolute":
        return inter.withColumn("base", W.interaction_weight())
    joined = inter.join(rating_stats(inter), "username", "left")
    made = W.z_weight(F.col("mean"), F.col("deviation")) if mode == "normalized" else W.blended_weight(F.col("mean"), F.col("deviation"), F.col("n_ratings"))
    return joined.withColumn("base", made).drop("mean", "deviation", "n_ratings")


def list_multiplier(lists: DataFrame) -> DataFrame:
    """(username, slug, multiplier): the best list that a film stands in."""
    return lists.groupBy("username", F.col("film_slug").alias("slug")).agg(F.max(W.list_weight()).alias("multiplier"))


def weighted(inter: DataFrame, lists: DataFrame, asof: Column, mode: str = "absolute", decay: bool = True) -> DataFrame:
    """(username, slug, rating, liked, scraped_at, age, w): what each interaction counts; zero weights are gone."""
    base = with_base_weight(inter, mode).join(list_multiplier(lists), ["username", "slug"], "left")
    age = W.temporal_weight(F.col("scraped_at"), asof) if decay else F.lit(1.0)
    out = base.withColumn("age", age).withColumn("w", F.col("base") * F.col("age") * F.coalesce("multiplier", F.lit(1.0)))
    return out.filter("w <> 0").select("username", "slug", "rating", "liked", "scraped_at", "age", "w")


def with_decades(attrs: DataFrame, films: DataFrame) -> DataFrame:
    """attrs and, as a further kind, each film's decade; a film without a year has none."""
    decade = (F.floor(F.col("year") / 10) * 10).cast("string")
    return attrs.unionByName(films.filter("year <> 0").select("slug", F.lit("decade").alias("attr_type"), decade.alias("attr_value"), F.lit(1).alias("pos")))


def scale() -> Column:
    kind = F.col("attr_type")
    later = F.when((kind == "country") & (F.col("pos") > 1), LATER_COUNTRY).otherwise(1.0)
    return F.when(kind == "actor", SCALE["actor"]).when(kind == "theme", SCALE["theme"]).otherwise(later)


def deep_enough(attrs: DataFrame) -> DataFrame:
    kind = F.col("attr_type")
    return attrs.filter(((kind != "actor") | (F.col("pos") <= DEPTH["actor"])) & ((kind != "theme") | (F.col("pos") <= DEPTH["theme"])))


def dampened(total: Column, n: Column, kind: Column) -> Column:
    return total / F.pow(n, F.when(kind == "actor", ACTOR_EXPONENT).otherwise(EXPONENT))


def profile_attrs(weights: DataFrame, attrs: DataFrame) -> DataFrame:
    """(username, attr_type, attr_value, score, n) over what weighted() gives. One shuffle on the films, one on the result's
    key after partial sums."""
    joined = weights.join(deep_enough(attrs), "slug").withColumn("x", F.col("w") * scale())
    sums = joined.groupBy("username", "attr_type", "attr_value").agg(F.sum("x").alias("total"), F.count("*").alias("n"))
    return sums.select("username", "attr_type", "attr_value", dampened(F.col("total"), F.col("n"), F.col("attr_type")).alias("score"), "n")


def film_genre_pairs(attrs: DataFrame) -> DataFrame:
    """(slug, a, b) for each unordered pair of a film's genres; pairs come from one array a film, not from a self-join."""
    genres = attrs.filter("attr_type = 'genre'").groupBy("slug").agg(F.array_sort(F.collect_set("attr_value")).alias("g"))
    first = genres.select("slug", "g", F.posexplode("g").alias("i", "a"))
    return first.select("slug", "a", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("b"))


def genre_pairs(weights: DataFrame, attrs: DataFrame, least: int = 2) -> DataFrame:
    """(username, a, b, score, n)."""
    sums = weights.join(film_genre_pairs(attrs), "slug").groupBy("username", "a", "b").agg(F.sum("w").alias("total"), F.count("*").alias("n"))
    return sums.filter(F.col("n") >= least).select("username", "a", "b", (F.col("total") / F.sqrt("n")).alias("score"), "n")


def genre_interactions(inter: DataFrame, attrs: DataFrame, least: int = 3) -> DataFrame:
    """(username, a, b, effect, n): how the mean rating of a genre pair differs from the mean of both genres' means."""
    rated = inter.filter("rating is not null").select("username", "slug", "rating")
    single = rated.join(attrs.filter("attr_type = 'genre'").select("slug", F.col("attr_value").alias("g")), "slug")
    single = single.groupBy("username", "g").agg(F.avg("rating").alias("mean"))
    pairs = rated.join(film_genre_pairs(attrs), "slug").groupBy("username", "a", "b").agg(F.avg("rating").alias("mean"), F.count("*").alias("n"))
    pairs = pairs.filter(F.col("n") >= least)
    named = lambda x: single.select("username", F.col("g").alias(x), F.col("mean").alias(f"mean_{x}"))
    both = pairs.join(named("a"), ["username", "a"]).join(named("b"), ["username", "b"])
    return both.select("username", "a", "b", (F.col("mean") - (F.col("mean_a") + F.col("mean_b")) / 2).alias("effect"), "n")


def preference_momentum(inter: DataFrame, attrs: DataFrame, asof: Column, window_days: int = 180) -> DataFrame:
    """(username, attr_type, attr_value, momentum) for directors and genres rated twice or more both lately and before.

    A side with two ratings or fewer counts as mean 0. Nine decimals, so that the order of sums can't move it over a bound."""
    rated = inter.filter("rating is not null and scraped_at is not null").withColumn("x", (F.col("rating") - 2.5) / 2.5)
    rated = rated.withColumn("recent", F.col("scraped_at") > asof - F.make_dt_interval(F.lit(window_days)))
    joined = rated.join(attrs.filter("attr_type in ('director', 'genre')"), "slug")
    of = lambda side: F.when(F.col("recent") == side, F.col("x"))
    sums = joined.groupBy("username", "attr_type", "attr_value").agg(
        F.sum(of(True)).alias("sr"), F.count(of(True)).alias("nr"), F.sum(of(False)).alias("so"), F.count(of(False)).alias("no")
    )
    mean = lambda s, n: F.when(F.col(n) > 2, F.col(s) / F.col(n)).otherwise(0.0)
    return sums.filter("nr >= 2 and no >= 2").select("username", "attr_type", "attr_value", F.round(mean("sr", "nr") - mean("so", "no"), 9).alias("momentum"))


def profile_stats(weights: DataFrame, films: DataFrame) -> DataFrame:
    """(username, n_films, n_rated, n_liked, mean_rating, deviation, weighted_mean) over catalogued films."""
    known = weights.join(films.select("slug"), "slug", "left_semi")
    return known.groupBy("username").agg(
        F.count("*").alias("n_films"), F.count("rating").alias("n_rated"), F.count_if("liked").alias("n_liked"),
        F.avg("rating").alias("mean_rating"), F.stddev_pop("rating").alias("deviation"),
        (F.sum(F.col("rating") * F.col("age")) / F.sum(F.when(F.col("rating").isNotNull(), F.col("age")))).alias("weighted_mean"),
    )


def top_preferences(profile: DataFrame, k: int = 10) -> DataFrame:
    """(username, attr_type, rank, attr_value, score): the best k of each kind."""
    w = Window.partitionBy("username", "attr_type").orderBy(F.desc("score"), "attr_value")
    return profile.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("username", "attr_type", "rank", "attr_value", "score")
