"""Filters, clean-up and statistics over films, interactions, lists and follow edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- filters ----


def filter_years(films: DataFrame, lo: int | None = None, hi: int | None = None, nulls: str = "drop") -> DataFrame:
    """Films of these years; nulls: drop or keep those without one."""
    fine = F.lit(True)
    if lo is not None:
        fine &= F.col("year") >= lo
    if hi is not None:
        fine &= F.col("year") <= hi
    return films.filter(fine | F.col("year").isNull() if nulls == "keep" else fine)


def filter_genres(films: DataFrame, attrs: DataFrame, include: list[str] = (), exclude: list[str] = (), lower: bool = True) -> DataFrame:
    """Films with any of the included genres and none of the excluded."""
    genres = attrs.filter("attr_type = 'genre'")
    fold = lambda names: [n.lower() for n in names] if lower else list(names)
    if include:
        films = films.join(genres.filter(F.col("attr_value").isin(fold(include))).select("slug"), "slug", "left_semi")
    if exclude:
        films = films.join(genres.filter(F.col("attr_value").isin(fold(exclude))).select("slug"), "slug", "left_anti")
    return films


def filter_min_rating(films: DataFrame, least: float, nulls: str = "keep") -> DataFrame:
    fine = F.col("avg_rating") >= least
    return films.filter(fine | F.col("avg_rating").isNull() if nulls == "keep" else fine)


def unseen_candidates(cands: DataFrame, inter: DataFrame, only_watched: bool = False) -> DataFrame:
    """(username, slug) pairs that the user has no record of, or hasn't watched."""
    seen = inter.filter("watched") if only_watched else inter
    return cands.join(seen.select("username", "slug"), ["username", "slug"], "left_anti")


def clean_username(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9_-]", "")


def clean_slug(slug: Column) -> Column:
    """Trimmed, lower case, with an optional film: prefix; null if that leaves anything but [a-z0-9-] or over 200 characters."""
    s = F.lower(F.trim(slug))
    return F.when((F.length(s) <= 200) & s.rlike("^(film:)?[a-z0-9-]+$"), s)


def active_users(inter: DataFrame, min_films: int = 50) -> DataFrame:
    users = inter.groupBy("username").agg(F.count("*").alias("n_films"), F.count("rating").alias("n_rated"))
    return users.filter((F.col("n_films") >= min_films) & (F.col("n_rated") >= 1))


def missing_metadata(inter: DataFrame, films: DataFrame) -> DataFrame:
    """(username, n_missing): how many of a user's films aren't catalogued."""
    return inter.join(films.select("slug"), "slug", "left_anti").groupBy("username").agg(F.countDistinct("slug").alias("n_missing"))


def refresh_candidates(inter: DataFrame, films: DataFrame, min_count: int = 50, limit: int | None = None) -> DataFrame:
    """Slugs whose metadata is thin, and slugs that aren't catalogued."""
    thin = films.filter((F.coalesce("rating_count", F.lit(0)) < min_count) | F.col("avg_rating").isNull()).select("slug")
    out = thin.unionByName(inter.select("slug").join(films.select("slug"), "slug", "left_anti")).distinct()
    return out.orderBy("slug").limit(limit) if limit else out


def stale_users(inter: DataFrame, asof: Column, days: int) -> DataFrame:
    last = inter.groupBy("username").agg(F.max("scraped_at").alias("last_seen"))
    return last.withColumn("age_days", F.timestamp_diff("DAY", "last_seen", asof)).filter(F.col("age_days") >= days)


# ---- upserts ----


def upsert_latest(base: DataFrame, delta: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: delta's over base's, then by order, latest first."""
    both = base.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), *[F.desc_nulls_last(c) for c in order])
    return both.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_new", "_rank")


ATTRIBUTES = ("director", "genre", "actor", "theme", "country", "language", "writer", "cinematographer", "composer")


def decode_lists(films: DataFrame, columns: list[str]) -> DataFrame:
    """films with JSON texts of lists as arrays; bad JSON, null and empty texts are empty arrays."""
    none = F.array().cast("array<string>")
    return films.withColumns({c: F.coalesce(F.from_json(F.col(c), "array<string>"), none) for c in columns})


def normalize_attrs(films: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(slug, attr_type, attr_value, pos) from array columns, by kind; a value counts at its first place."""
    rows = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("v")) for kind, c in columns.items()])).alias("a")
    long = films.select("slug", rows).select("slug", F.col("a.kind").alias("attr_type"), F.posexplode("a.v").alias("p", "attr_value"))
    return long.filter("attr_value is not null").groupBy("slug", "attr_type", "attr_value").agg((F.min("p") + 1).cast("int").alias("pos"))


def replace_attrs(attrs: DataFrame, fresh: DataFrame) -> DataFrame:
    """fresh stands for all that attrs has of its films."""
    return attrs.join(fresh.select("slug").distinct(), "slug", "left_anti").unionByName(fresh)


def upsert_follows(edges: DataFrame, new: DataFrame, both_ways: bool = False) -> DataFrame:
    added = new.unionByName(new.select(F.col("followee").alias("follower"), F.col("follower").alias("followee"))) if both_ways else new
    return edges.unionByName(added).dropDuplicates(["follower", "followee"])


# ---- statistics ----

IDF_KINDS = ("genre", "director", "actor", "theme", "country", "language")


def attribute_idf(attrs: DataFrame, films: DataFrame) -> DataFrame:
    """(attr_type, attr_value, doc_count, idf); the logarithm may be negative. The count of films is one broadcast row."""
    df = attrs.filter(F.col("attr_type").isin(*IDF_KINDS)).groupBy("attr_type", "attr_value").agg(F.countDistinct("slug").alias("doc_count"))
    n = F.broadcast(films.agg(F.count("*").alias("n_films")))
    return df.crossJoin(n).select("attr_type", "attr_value", "doc_count", F.log(F.col("n_films") / (1 + F.col("doc_count"))).alias("idf"))


def explore(attrs: DataFrame, films: DataFrame, kind: str, k: int = 5) -> DataFrame:
    """(attr_value, rank, slug, rating_count): the k films of most ratings for each value of a kind."""
    rows = attrs.filter(F.col("attr_type") == kind).join(films.select("slug", "rating_count"), "slug")
    w = Window.partitionBy("attr_value").orderBy(F.desc("rating_count"), "slug")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("attr_value", "rank", "slug", "rating_count")


def db_stats(inter: DataFrame, films: DataFrame) -> DataFrame:
    """One row of counts."""
    users = inter.agg(F.countDistinct("username").alias("n_users"), F.count("*").alias("n_interactions"), F.count("rating").alias("n_rated"))
    known = films.agg(F.count("*").alias("n_films"))
    gaps = inter.select("slug").distinct().join(films.select("slug"), "slug", "left_anti").agg(F.count("*").alias("n_uncatalogued"))
    return users.crossJoin(known).crossJoin(gaps)


def top_users(inter: DataFrame, k: int = 5) -> DataFrame:
    return inter.groupBy("username").agg(F.count("*").alias("n_films")).orderBy(F.desc("n_films"), "username").limit(k)


def oldest_users(inter: DataFrame, k: int = 5) -> DataFrame:
    """The k users whose newest record is the oldest."""
    return inter.groupBy("username").agg(F.max("scraped_at").alias("last_seen")).orderBy("last_seen", "username").limit(k)


def top_genres(attrs: DataFrame, k: int = 10) -> DataFrame:
    """The k genres of most films."""
    g = attrs.filter("attr_type = 'genre'").groupBy(F.col("attr_value").alias("genre")).agg(F.countDistinct("slug").alias("n_films"))
    return g.orderBy(F.desc("n_films"), "genre").limit(k)


def social_stats(follows: DataFrame) -> DataFrame:
    return follows.agg(F.count("*").alias("n_edges"), F.countDistinct("follower").alias("n_followers"), F.countDistinct("followee").alias("n_followees"))


def users_without_social(inter: DataFrame, follows: DataFrame) -> DataFrame:
    linked = follows.select(F.explode(F.array("follower", "followee")).alias("username")).distinct()
    return inter.select("username").distinct().join(linked, "username", "left_anti")
