"""The discovery queue, cached profiles, rating matrix and bias model as tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palate.operators.blocks import best_unseen
from palate.operators.scoring import top_n
from palate.sources.shared import shared_table

PRIORITY = {"film_reviews": 100, "taste": 90, "followers": 80, "following": 80, "popular": 70, "film": 50}


def priority(source: Column) -> Column:
    out = F.lit(50)
    for k, v in PRIORITY.items():
        out = F.when(source == k, v).otherwise(out)
    return out


def queue_add(cands: DataFrame, pending: DataFrame, inter: DataFrame) -> DataFrame:
    """(username, source_type, discovered_at, priority): each name's first sight, unless it is pending or has data."""
    first = cands.groupBy("username").agg(F.min(F.struct("discovered_at", "event_id", "source_type")).alias("f"))
    new = first.select("username", "f.source_type", "f.discovered_at").join(pending.select("username"), "username", "left_anti")
    return new.join(inter.select("username"), "username", "left_anti").withColumn("priority", priority(F.col("source_type")))


def queue_next(pending: DataFrame, n: int) -> DataFrame:
    return pending.orderBy(F.desc("priority"), "discovered_at", "username").limit(n)


def queue_stats(pending: DataFrame, seconds_each: int = 30) -> DataFrame:
    g = pending.agg(F.count("*").alias("total"), F.countDistinct("source_type").alias("n_sources"), F.avg("priority").alias("mean_priority"))
    return g.withColumn("hours", F.col("total") * seconds_each / 3600)


def queue_breakdown(pending: DataFrame) -> DataFrame:
    return pending.groupBy("source_type", "priority").agg(F.count("*").alias("n"))


def queue_prune(pending: DataFrame, asof: Column, days: int | None = None, max_priority: int | None = None, source: str | None = None) -> DataFrame:
    """pending without entries that meet every given condition."""
    gone = F.lit(True)
    if days is not None:
        gone &= F.timestamp_diff("DAY", "discovered_at", asof) >= days
    if max_priority is not None:
        gone &= F.col("priority") <= max_priority
    if source is not None:
        gone &= F.col("source_type") == source
    return pending.filter(~gone)


def refill_plan(sources: DataFrame, room: int, asof: Column, days: int = 7, each: int = 50) -> DataFrame:
    """(source, take): sources in order, without those refreshed lately, each for 50 x its weight until there is no room.

    Sources are a small table of settings, walked in one order."""
    able = sources.filter(F.col("refreshed_at").isNull() | (F.timestamp_diff("DAY", "refreshed_at", asof) >= days)).withColumn("want", F.floor(each * F.col("weight")))
    before = F.coalesce(F.sum("want").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return able.withColumn("take", F.least("want", F.lit(room) - before).cast("long")).filter("take > 0").select("source", "take")


def taste_seeds(inter: DataFrame, least: float = 4.0, k: int = 20) -> DataFrame:
    """(username, candidate, n_common): who else rated a user's k favourite films."""
    w = Window.partitionBy("username").orderBy(F.desc("rating"), "slug")
    top = inter.filter(F.col("rating") >= least).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("username", "slug")
    others = inter.filter("rating is not null").select(F.col("username").alias("candidate"), "slug")
    return top.join(others, "slug").filter("username <> candidate").groupBy("username", "candidate").agg(F.count("*").alias("n_common"))


def stale_sources(sources: DataFrame, asof: Column, days: int) -> DataFrame:
    age = sources.groupBy("source_type").agg(F.max("discovered_at").alias("last"))
    return age.withColumn("age_days", F.timestamp_diff("DAY", "last", asof)).filter(F.col("age_days") >= days)


# ---- cached profiles ----


def valid_profiles(profiles: DataFrame, inter: DataFrame, asof: Column, version: int, days: int = 7, lists: DataFrame | None = None) -> DataFrame:
    """Usernames whose cached profile has this version, is young enough and not older than their newest interaction or,
    where lists (username, scraped_at) are given, list entry."""
    said = inter.select("username", "scraped_at")
    newest = (said if lists is None else said.unionByName(lists.select("username", "scraped_at"))).groupBy("username").agg(F.max("scraped_at").alias("newest"))
    fine = (F.col("schema_version") == version) & (F.timestamp_diff("DAY", "updated_at", asof) <= days)
    return profiles.join(newest, "username", "left").filter(fine & (F.col("newest").isNull() | (F.col("updated_at") >= F.col("newest")))).select("username")


def stale_profiles(profiles: DataFrame, inter: DataFrame, asof: Column, version: int, days: int = 7) -> DataFrame:
    return inter.select("username").distinct().join(valid_profiles(profiles, inter, asof, version, days), "username", "left_anti")


def refresh_profiles(cached: DataFrame, stale: DataFrame, fresh: DataFrame) -> DataFrame:
    """cached, (username, attr_type, attr_value, score, n), with all rows of stale users replaced by fresh ones.

    fresh may cover all users: only those of stale users are taken, and Spark computes them for these alone where the
    filter on username goes down to the source."""
    return cached.join(stale.select("username"), "username", "left_anti").unionByName(fresh.join(stale.select("username"), "username", "left_semi"))


def purge_profiles(profiles: DataFrame, version: int) -> DataFrame:
    return profiles.filter(F.col("schema_version") == version)


# ---- rating matrix ----


def rating_matrix(inter: DataFrame, weight: float = 0.3) -> DataFrame:
    """(username, slug, value): the rating, else what flags stand for, times weight."""
    implicit = F.when(F.col("liked"), 4.5).when(F.col("watched"), 3.0).when(F.col("watchlisted"), 2.5)
    return inter.select("username", "slug", F.coalesce("rating", implicit * weight).alias("value")).filter("value is not null")


def bias_model(matrix: DataFrame) -> DataFrame:
    """(kind, id, bias): the global mean, and how each user's and item's mean differs from it."""
    mu = F.broadcast(matrix.agg(F.avg("value").alias("mu")))  # one row
    of = lambda kind, c: matrix.groupBy(F.col(c).alias("id")).agg(F.avg("value").alias("m")).crossJoin(mu).select(F.lit(kind).alias("kind"), "id", (F.col("m") - F.col("mu")).alias("bias"))
    return mu.select(F.lit("global").alias("kind"), F.lit("").alias("id"), F.col("mu").alias("bias")).unionByName(of("user", "username")).unionByName(of("item", "slug"))


def svd_diagnostics(matrix: DataFrame) -> DataFrame:
    users = matrix.groupBy("username").agg(F.round(F.avg("value"), 9).alias("m"))
    ends = users.agg(F.max(F.struct("m", "username")).alias("hi"), F.min(F.struct("m", "username")).alias("lo"))
    size = matrix.agg(F.countDistinct("username").alias("n_users"), F.countDistinct("slug").alias("n_items"), F.count("*").alias("n_values"), F.avg("value").alias("global_mean"))
    return size.crossJoin(ends.select(F.col("hi.username").alias("most_generous"), F.col("lo.username").alias("harshest")))


def fit_svd(matrix: DataFrame, factors: int = 50) -> tuple[DataFrame, DataFrame]:
    """((username, u), (slug, v)): truncated SVD of the centred stored entries, the square root of each singular value in
    both factors.

    The distributed row matrix gives users' factors and singular values. Items' factors are the entries times users'
    factors, a join and a sum, and so are never brought to the driver; computeSVD itself works with vectors of the items there."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.mllib.linalg.distributed import CoordinateMatrix

    bias = bias_model(matrix)
    of = lambda kind, c, name: bias.filter(F.col("kind") == kind).select(F.col("id").alias(c), F.col("bias").alias(name))
    mu = bias.filter("kind = 'global'").select(F.col("bias").alias("mu"))
    c = matrix.join(of("user", "username", "bu"), "username").join(of("item", "slug", "bi"), "slug").crossJoin(F.broadcast(mu))
    users, items = shared_table(numbered(matrix, "username"), "users"), shared_table(numbered(matrix, "slug"), "items")
    left = (F.col("value") - F.col("mu") - F.col("bu") - F.col("bi")).alias("x")
    entries = c.join(users.withColumnRenamed("number", "user"), "username").join(items.withColumnRenamed("number", "item"), "slug")
    entries = shared_table(entries.select("user", "item", "slug", left), "entries")
    n_u, n_i = users.count(), items.count()
    rows = CoordinateMatrix(entries.select("user", "item", "x").rdd.map(tuple), n_u, n_i).toIndexedRowMatrix()
    svd = rows.computeSVD(max(1, min(factors, min(n_u, n_i) - 1)), computeU=True)
    root = [float(s) ** 0.5 for s in svd.s.toArray()]
    left_vectors = svd.U.rows.map(lambda r: (r.index, r.vector)).toDF(["user", "left"])
    u = shared_table(left_vectors.select("user", vector_to_array("left").alias("left")), "left")
    wide = F.array(*[F.col("left")[k] * s for k, s in enumerate(root)])
    sums = [F.sum(F.col("x") * F.col("left")[k]) / s for k, s in enumerate(root)]
    v = entries.join(u, "user").groupBy("slug").agg(F.array(*sums).alias("v"))
    return u.join(users, F.col("user") == F.col("number")).select("username", wide.alias("u")), v


def numbered(names: DataFrame, name: str) -> DataFrame:
    """(name, number): the names of a column, numbered from 0 without a gap. Each partition numbers its own rows; only the
    partitions' sizes meet."""
    own = names.select(name).filter(F.col(name).isNotNull()).distinct()
    own = shared_table(own.withColumn("part", F.spark_partition_id()), "names")
    sizes = own.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("part").orderBy(name)) - 1
    return own.withColumn("place", place).join(sizes.select("part", before.alias("before")), "part").select(name, (F.col("place") + F.col("before")).cast("int").alias("number"))


def fit_als(matrix: DataFrame, factors: int = 50, rounds: int = 10, penalty: float = 0.05, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """((username, u), (slug, v)): alternating least squares over the centred stored entries, in blocks of users and items.

    A model of its own beside fit_svd(): entries that aren't stored are unknown here, not zero. Factors stay tables; none
    goes through the driver. predict_svd() and recommend_svd() take either. Up to 2^31 users and items."""
    from pyspark.ml.recommendation import ALS

    bias = bias_model(matrix)
    of = lambda kind, c, name: bias.filter(F.col("kind") == kind).select(F.col("id").alias(c), F.col("bias").alias(name))
    mu = bias.filter("kind = 'global'").select(F.col("bias").alias("mu"))
    users, items = shared_table(numbered(matrix, "username"), "users"), shared_table(numbered(matrix, "slug"), "items")
    c = matrix.join(of("user", "username", "bu"), "username").join(of("item", "slug", "bi"), "slug").crossJoin(F.broadcast(mu))
    left = (F.col("value") - F.col("mu") - F.col("bu") - F.col("bi")).cast("float")
    entries = c.join(users.withColumnRenamed("number", "user"), "username").join(items.withColumnRenamed("number", "item"), "slug")
    entries = shared_table(entries.select("user", "item", left.alias("rating")), "ratings")
    als = ALS(rank=factors, maxIter=rounds, regParam=penalty, seed=seed, userCol="user", itemCol="item", ratingCol="rating", checkpointInterval=-1)
    model = als.fit(entries)
    wide = lambda df, names, c, f: df.join(names, df["id"] == names["number"]).select(c, F.col("features").cast("array<double>").alias(f))
    return wide(model.userFactors, users, "username", "u"), wide(model.itemFactors, items, "slug", "v")


def predict_svd(pairs: DataFrame, bias: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """(username, slug, prediction) from 0.5 to 5; null for users or items that the model doesn't know."""
    of = lambda kind, c, name: bias.filter(F.col("kind") == kind).select(F.col("id").alias(c), F.col("bias").alias(name))
    mu = bias.filter("kind = 'global'").select(F.col("bias").alias("mu"))
    j = pairs.join(users, "username", "left").join(items, "slug", "left").join(of("user", "username", "bu"), "username", "left").join(of("item", "slug", "bi"), "slug", "left").crossJoin(F.broadcast(mu))
    dot = F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    raw = F.col("mu") + F.col("bu") + F.col("bi") + dot
    return j.select("username", "slug", F.when(raw.isNotNull(), F.greatest(F.least(raw, F.lit(5.0)), F.lit(0.5))).alias("prediction"))


def recommend_svd(bias: DataFrame, users: DataFrame, items: DataFrame, inter: DataFrame, films: DataFrame | None = None, n: int = 10) -> DataFrame:
    """(username, rank, slug, score): the unseen items of largest prediction, not clipped, of each user that the model knows.

    films, where given, filters the best 3 n, so a user may get fewer than n."""
    of = lambda kind, c, name: bias.filter(F.col("kind") == kind).select(F.col("id").alias(c), F.col("bias").alias(name))
    mu = bias.filter("kind = 'global'").first()["bias"]  # one row
    people = users.join(of("user", "username", "b"), "username").join(inter.groupBy("username").agg(F.collect_set("slug").alias("seen")), "username", "left")
    things = items.join(of("item", "slug", "b"), "slug")

    def score(u: pd.DataFrame, f: pd.DataFrame) -> np.ndarray:
        a, b = np.array(u["u"].tolist()), np.array(f["v"].tolist())
        return mu + u["b"].to_numpy(float)[:, None] + f["b"].to_numpy(float)[None] + a @ b.T

    deep = n if films is None else 3 * n
    found = top_n(best_unseen(people, things, deep, score).withColumn("score", F.round("score", 9)), deep)
    if films is not None:
        found = found.join(films.select("slug"), "slug", "left_semi")
    return top_n(found, n).select("username", "rank", "slug", "score")


def same_model(fingerprint: DataFrame, stored: DataFrame) -> bool:
    """Whether a stored model's fingerprint row is this one, so that its factors may be loaded."""
    return not fingerprint.exceptAll(stored.select(*fingerprint.columns)).take(1)


def model_fingerprint(matrix: DataFrame, **params) -> DataFrame:
    said = ",".join(f"{k}={v}" for k, v in sorted(params.items()))
    g = matrix.agg(F.countDistinct("username").alias("n_users"), F.countDistinct("slug").alias("n_items"), F.count("*").alias("n_ratings"))
    return g.withColumn("params", F.lit(said))
