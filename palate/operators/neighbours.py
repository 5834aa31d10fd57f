"""Similar users and items from ratings, and film similarity from attribute tokens."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palate.operators.pairs import POSTINGS, Columns, best_in_rows, meet, ordered_entries
from palate.operators.reasons import liked_by, similar_to
from palate.operators.scoring import diversify, top_n
from palate.sources.shared import forget, shared_table

SHRINKAGE = 10.0
IMPLICIT = {"liked": 1.2, "watched": 0.4, "watchlisted": 0.25}
NO_SIGNAL = 0.05
DEBIAS = 0.15

# ---- TF-IDF ----

TOKEN_KINDS = ("genre", "director", "theme", "country", "language", "writer")


def tfidf_vectors(attrs: DataFrame, min_df: int = 2, max_features: int | None = None) -> DataFrame:
    """(slug, token, w): unit vectors over one vocabulary of lower-cased values; tf is over all of a film's tokens.

    max_features, where given, keeps that many tokens of largest idf."""
    tokens = attrs.filter(F.col("attr_type").isin(*TOKEN_KINDS)).select("slug", F.lower("attr_value").alias("token"))
    tf = tokens.groupBy("slug", "token").agg(F.count("*").alias("c")).withColumn("tf", F.col("c") / F.sum("c").over(Window.partitionBy("slug")))
    n = F.broadcast(attrs.agg(F.countDistinct("slug").alias("n_docs")))  # one row
    df = tf.groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df).crossJoin(n)
    idf = df.select("token", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    if max_features is not None:
        idf = idf.orderBy(F.desc("idf"), "token").limit(max_features)
    raw = tf.join(idf, "token").withColumn("x", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("slug")))
    return raw.select("slug", "token", (F.col("x") / norm).alias("w"))


def tfidf_rank(vectors: DataFrame, k: int = 10, at_once: int = 1024) -> DataFrame:
    """(slug, rank, other, score): the k films of largest cosine. Films that share a frequent token are no rows: see meet().

    Films of equal vectors are a class, named by its first film. Classes meet; of the k best of each, by score and name,
    the k + 1 first films hold the k best of any film in it."""
    vectors = shared_table(vectors, "vectors")
    said = vectors.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("token", F.round("w", 12).alias("w")))).alias("v"))
    member = said.join(said.groupBy("v").agg(F.min("slug").alias("one")), "v").select("slug", "one")
    member = shared_table(member, "classes")
    apart = vectors.join(member.filter("slug = one").select("slug"), "slug", "left_semi").select(F.col("slug").alias("one"), F.col("token").alias("what"), "w")
    entries = ordered_entries(apart)
    own = lambda c: c["w"]

    def choose(one: Columns, other: Columns, sums: list[np.ndarray]) -> tuple:
        n, dot = sums
        score = np.round(dot, 9)
        i, j = best_in_rows(np.where(n > 0, score, -np.inf), k)
        return i, j, score[i, j]

    found = meet(entries, ["w"], [(own, own)], choose, "one string, other string, score double", at_once=at_once)
    alike = apart.groupBy("one").agg(F.round(F.sum(F.col("w") * F.col("w")), 9).alias("score")).select("one", F.col("one").alias("other"), "score")
    near = top_n(found, k, "one", "other").select("one", "other", "score").unionByName(alike)
    place = F.row_number().over(Window.partitionBy("one").orderBy("slug"))
    first = member.withColumn("place", place).filter(F.col("place") <= k + 1).select(F.col("one").alias("other"), F.col("slug").alias("film"))
    best = top_n(near.join(first, "other").select("one", "film", "score"), k + 1, "one", "film").drop("rank")
    of_film = member.join(best, "one").filter("slug <> film").select("slug", F.col("film").alias("other"), "score")
    return top_n(of_film, k, "slug", "other").select("slug", "rank", "other", "score")


def tfidf_centroid_rank(vectors: DataFrame, anchors: DataFrame, cands: DataFrame, k: int = 10) -> DataFrame:
    """(username, rank, slug, score): candidates by cosine to the normalised sum of the user's anchors."""
    total = anchors.select("username", "slug").join(vectors, "slug").groupBy("username", "token").agg(F.sum("w").alias("c"))
    norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy("username")))
    centroid = total.withColumn("c", F.col("c") / norm)
    met = cands.select("username", "slug").join(vectors, "slug").join(centroid, ["username", "token"])
    scores = met.groupBy("username", "slug").agg(F.round(F.sum(F.col("w") * F.col("c")), 9).alias("score")).filter("score > 0")
    return top_n(scores, k).select("username", "rank", "slug", "score")


# ---- users ----


def centered_ratings(inter: DataFrame) -> DataFrame:
    """(username, slug, rating, c, u): the rating less the user's mean, and that as a part of a unit vector."""
    w = Window.partitionBy("username")
    c = inter.filter("rating is not null").withColumn("c", F.col("rating") - F.avg("rating").over(w))
    norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(w))
    return c.select("username", "slug", "rating", "c", (F.col("c") / F.when(norm == 0, 1.0).otherwise(norm)).alias("u"))


def rated_pairs(inter: DataFrame) -> DataFrame:
    """(username, other, overlap, cosine, agreement) for users with a rated film in common: all of them, as rows."""
    mine = centered_ratings(inter).select("username", "slug", "rating", "u")
    theirs = mine.select(F.col("username").alias("other"), "slug", F.col("rating").alias("r2"), F.col("u").alias("u2"))
    met = mine.join(theirs, "slug").filter("username < other").groupBy("username", "other").agg(
        F.count("*").alias("overlap"), F.sum(F.col("u") * F.col("u2")).alias("cosine"), F.avg(1 - F.abs(F.col("rating") - F.col("r2")) / 4.5).alias("agreement")
    )
    return met.unionByName(met.select(F.col("other").alias("username"), F.col("username").alias("other"), "overlap", "cosine", "agreement"))


def rated_entries(inter: DataFrame) -> DataFrame:
    """Centred ratings as entries of an index, with the user's number of ratings and the norm of its share in common films."""
    c = centered_ratings(inter).select(F.col("username").alias("one"), F.col("slug").alias("what"), "rating", "u")
    return ordered_entries(c).withColumn("n", F.count("*").over(Window.partitionBy("one")).cast("double"))


def least_overlap(inter: DataFrame) -> int:
    """How many films two users must have in common: five, or two where there are under 20 users or 50 films."""
    size = inter.agg(F.countDistinct("username").alias("u"), F.countDistinct("slug").alias("i")).first()
    return 2 if size["u"] < 20 or size["i"] < 50 else 5


def confidence(n):
    """What a cosine over n common films counts: it grows with n, up to 1."""
    return np.minimum(n / 20.0, 1.0) * n / (n + SHRINKAGE)


def user_neighbors(entries: DataFrame, k: int = 10, min_overlap: int = 5, at_once: int = 1024, heavy: int = POSTINGS) -> DataFrame:
    """(username, rank, other, score): the cosine, less for few common films; the k best with min_overlap or more. Exact.

    entries: rated_entries(). Two users can't have min_overlap films in common without one outside the min_overlap - 1
    most frequent films of either, so of those each one with over `heavy` ratings stays out of a user's index: what all
    have rated brings nobody together. For pairs that meet, what the films left out can add is bounded by their number
    and norm; a pair goes on only if it could reach the k-th lower bound of its user, and those films are then looked up."""
    out = (F.col("place") < min_overlap) & (F.col("many") > heavy)
    whole = Window.partitionBy("one")
    own = entries.withColumn("n_out", F.count_if(out).over(whole).cast("double"))
    own = own.withColumn("hidden", F.sqrt(F.sum(F.when(out, F.col("u") * F.col("u")).otherwise(0.0)).over(whole)))

    def choose(one: Columns, other: Columns, sums: list[np.ndarray]) -> tuple:
        n, dot = sums
        rest, n_out = one["hidden"][:, None], one["n_out"][:, None]
        most = np.where((n > 0) & (n + n_out >= min_overlap), (dot + rest) * confidence(n + n_out), -np.inf)
        least = np.where((n >= min_overlap) & (dot > rest), (dot - rest) * confidence(n), 0.0)
        bar = np.partition(least, max(0, least.shape[1] - k), axis=1)[:, max(0, least.shape[1] - k)]
        i, j = np.nonzero((most > 0) & (most >= bar[:, None] - 1e-9))
        return i, j, n[i, j].astype(np.int64), dot[i, j]

    share = lambda c: c["u"]
    met = meet(own, ["u", "hidden", "n_out"], [(share, share)], choose, "one string, other string, n long, dot double", ~out, at_once=at_once)
    if not own.filter(out).isEmpty():
        met = shared_table(met, "met")
        left = own.filter(out).select("one", "what", F.col("u").alias("x"))
        more = met.select("one", "other").join(left, "one").join(own.select(F.col("one").alias("other"), "what", "u"), ["other", "what"])
        more = more.select("one", "other", F.lit(1).cast("long").alias("n"), (F.col("x") * F.col("u")).alias("dot"))
        met = met.unionByName(more).groupBy("one", "other").agg(F.sum("n").alias("n"), F.sum("dot").alias("dot"))
    n = F.col("n")
    score = F.round(F.col("dot") * F.least(n / 20.0, F.lit(1.0)) * n / (n + SHRINKAGE), 9)
    found = met.filter(n >= min_overlap).select(F.col("one").alias("username"), "other", score.alias("score")).filter("score > 0")
    return top_n(found, k, "username", "other").select("username", "rank", "other", "score")


def asymmetric_neighbors(entries: DataFrame, k: int = 10, at_once: int = 1024) -> DataFrame:
    """(username, role, rank, other, score): users who rate more are influencers, the others followers.

    entries: rated_entries(). The score is a sum over common films, so a task's k best of each role are enough."""

    def choose(one: Columns, other: Columns, sums: list[np.ndarray]) -> tuple:
        n, agreed = sums
        ratio = other["n"][None, :] / one["n"][:, None]
        leads = ratio > 1
        weight = np.where(leads, np.minimum(ratio, 2.0), np.minimum(1 / np.maximum(ratio, 0.1), 2.0))
        score = np.round(agreed * weight / 20, 9)
        i, j = (np.concatenate(p) for p in zip(*(best_in_rows(np.where((n > 0) & (leads == role), score, -np.inf), k) for role in (True, False))))
        return i, j, leads[i, j], score[i, j]

    sums = lambda x, y: [1 - np.abs(x["rating"] - y["rating"]) / 4.5]
    rows = meet(entries, ["rating", "n"], sums, choose, "username string, other string, leads boolean, score double", at_once=at_once)
    rows = rows.select("username", F.when(F.col("leads"), "influencer").otherwise("follower").alias("role"), "other", "score")
    w = Window.partitionBy("username", "role").orderBy(F.desc("score"), "other")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("username", "role", "rank", "other", "score")


def popularity_debias(count: Column) -> Column:
    factor = F.greatest(F.lit(0.1), 1 - DEBIAS * F.log1p(count.cast("double")) / F.log1p(F.lit(100_000.0)))
    return F.when(count > 0, factor).otherwise(1.0)


def chosen_neighbours(entries: DataFrame, k: int, min_overlap: int = 5) -> DataFrame:
    """(username, other, sim): the k best of similar users and influencers."""
    near = user_neighbors(entries, k, min_overlap).select("username", "other", "score")
    lead = asymmetric_neighbors(entries, k).filter("role = 'influencer'").select("username", "other", "score")
    both = near.unionByName(lead).groupBy("username", "other").agg(F.max("score").alias("score"))
    return top_n(both, k, "username", "other").select("username", "other", F.col("score").alias("sim"))


def votes_of(inter: DataFrame) -> DataFrame:
    """(other, slug, said): what a user's record of a film says to others."""
    implicit = sum((F.when(F.col(c), w).otherwise(0.0) for c, w in IMPLICIT.items()), F.lit(0.0))
    said = F.when(F.col("rating").isNotNull(), F.col("rating") - 2.5).otherwise(F.when(implicit == 0, NO_SIGNAL).otherwise(implicit))
    return inter.select(F.col("username").alias("other"), "slug", said.alias("said"))


def recommend_collaborative(
    inter: DataFrame, films: DataFrame, n: int = 20, min_neighbors: int = 3, min_overlap: int | None = None, reasons: bool = False
) -> DataFrame:
    """(username, rank, slug, score): what neighbours rate and like, of films that the user has no record of; where
    there are fewer than min_neighbors, films similar to the user's own favourites as well. min_overlap: least_overlap()
    where none is given. reasons adds an array of three texts at most: neighbours who like it, then similar favourites.

    Entries, which three plans read, are a shared table; similar films are looked for only from the favourites
    of users with few neighbours, if there are any."""
    k = max(10, 2 * min_neighbors)
    min_overlap = least_overlap(inter) if min_overlap is None else min_overlap
    entries = shared_table(rated_entries(inter), "rated")
    chosen = shared_table(chosen_neighbours(entries, k, min_overlap), "chosen")
    forget(entries)
    votes = chosen.join(votes_of(inter), "other").groupBy("username", "slug").agg(F.sum(F.col("said") * F.col("sim")).alias("score"))
    votes = votes.join(films.select("slug", "rating_count"), "slug", "left")
    scores = votes.select("username", "slug", (F.col("score") * popularity_debias(F.col("rating_count"))).alias("score"))
    few = inter.select("username").distinct().join(chosen.groupBy("username").count().filter(F.col("count") >= min_neighbors), "username", "left_anti")
    anchors = shared_table(inter.filter("rating >= 3.5 or liked").select("username", "slug").join(few, "username", "left_semi"), "anchors")
    said = []
    if reasons:
        votes_ = votes_of(inter).join(films.select("slug", popularity_debias(F.col("rating_count")).alias("factor")), "slug", "left").fillna(1.0, ["factor"])
        said.append(liked_by(chosen, votes_).withColumnRenamed("reasons", "liked"))
    if not anchors.isEmpty():
        sim = item_similarity(inter, only=anchors.select("slug").distinct())
        more = item_recommend(sim, anchors, inter, 2 * n).select("username", "slug", "score")
        scores = scores.unionByName(more)
        if reasons:
            said.append(similar_to(anchors, sim, more).withColumnRenamed("reasons", "alike"))
    scores = scores.groupBy("username", "slug").agg(F.round(F.sum("score"), 9).alias("score"))
    unseen = scores.join(inter.select("username", "slug"), ["username", "slug"], "left_anti")
    best = top_n(unseen, n).select("username", "rank", "slug", "score")
    if not reasons:
        return best
    names = ["liked", "alike"][: len(said)]
    for part in said:
        best = best.join(part, ["username", "slug"], "left")
    none = F.array().cast("array<string>")
    return best.select("username", "rank", "slug", "score", F.slice(F.concat(*[F.coalesce(c, none) for c in names]), 1, 3).alias("reasons"))


# ---- items ----


def item_similarity(inter: DataFrame, k: int = 50, max_items: int | None = None, only: DataFrame | None = None, at_once: int = 1024) -> DataFrame:
    """(slug, other, sim): adjusted cosine over common users only, two at least, above 0.3, the k best.

    max_items, where given, keeps that many films with most ratings; only, where given, holds the slugs that are asked for.
    A user with very many ratings makes no pair a row: see meet()."""
    c = centered_ratings(inter).filter("rating <> 0").select("username", "slug", "c")
    many = c.groupBy("slug").agg(F.count("*").alias("n")).filter("n >= 2")
    if max_items is not None:
        many = many.orderBy(F.desc("n"), "slug").limit(max_items)
    c = c.join(many.select("slug"), "slug", "left_semi").select(F.col("slug").alias("one"), F.col("username").alias("what"), "c")

    def choose(one: Columns, other: Columns, sums: list[np.ndarray]) -> tuple:
        n, d, a, b = sums
        fine = (n >= 2) & (a > 0) & (b > 0)
        score = np.round(d / np.sqrt(np.where(fine, a, 1.0)) / np.sqrt(np.where(fine, b, 1.0)), 9)
        i, j = best_in_rows(np.where(fine & (score > 0.3), score, -np.inf), k)
        return i, j, score[i, j]

    plain, square, one_ = (lambda c: c["c"]), (lambda c: c["c"] * c["c"]), (lambda c: np.ones(len(c["c"])))
    sums = [(plain, plain), (square, one_), (one_, square)]
    asked = only.select(F.col("slug").alias("one")) if only is not None else None
    found = meet(ordered_entries(c), ["c"], sums, choose, "slug string, other string, score double", asked=asked, at_once=at_once)
    return top_n(found, k, "slug", "other").select("slug", "other", F.col("score").alias("sim"))


def item_recommend(sim: DataFrame, anchors: DataFrame, inter: DataFrame, k: int = 20) -> DataFrame:
    """(username, rank, slug, score): films by their summed similarity to the user's anchors.

    Similar films travel to the user in lists, one an anchor, and are summed there. Who has m records finds the k best
    unseen films among the first m + k, so no more are held against the records."""
    lists = sim.groupBy("slug").agg(F.collect_list(F.struct("other", "sim")).alias("near"))
    met = anchors.select("username", "slug").join(lists, "slug").select("username", "near").repartition("username")
    near = met.select("username", F.explode("near").alias("n")).groupBy("username", F.col("n.other").alias("slug")).agg(F.round(F.sum("n.sim"), 9).alias("score"))
    own = inter.groupBy("username").agg(F.count("*").alias("seen"))
    place = F.row_number().over(Window.partitionBy("username").orderBy(F.desc("score"), "slug"))
    near = near.withColumn("place", place).join(own, "username", "left").filter(F.col("place") <= k + F.coalesce("seen", F.lit(0))).select("username", "slug", "score")
    unseen = near.join(inter.select("username", "slug"), ["username", "slug"], "left_anti")
    return top_n(unseen, k).select("username", "rank", "slug", "score")


# ---- fusion ----


def fuse_normalized(meta: DataFrame, collab: DataFrame, wm: float = 0.6, wc: float = 0.4, both_bonus: float = 0.1, own: DataFrame | None = None) -> DataFrame:
    """(username, slug, score): both scores scaled to 0..1 for each user and weighed; a film in both gets a bonus.

    own: (username, wm, wc), where given, has weights of their own for some users."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("username")
        low, high = F.min("score").over(w), F.max("score").over(w)
        return df.select("username", "slug", ((F.col("score") - low) / F.when(high == low, 1.0).otherwise(high - low)).alias(name))

    joined = scaled(meta, "m").join(scaled(collab, "c"), ["username", "slug"], "full")
    if own is not None:
        joined = joined.join(own, "username", "left")
    weigh = lambda name, w: F.coalesce(name, F.lit(w)) if own is not None else F.lit(w)
    bonus = F.when(F.col("m").isNotNull() & F.col("c").isNotNull(), both_bonus).otherwise(0.0)
    score = weigh("wm", wm) * F.coalesce("m", F.lit(0.0)) + weigh("wc", wc) * F.coalesce("c", F.lit(0.0)) + bonus
    return joined.select("username", "slug", F.round(score, 9).alias("score"))


def hybrid_weights(inter: DataFrame) -> DataFrame:
    """(username, wm, wc): metadata weighs 0.7 for users with under 20 ratings, and for all where there are under 10 users; else 0.6."""
    counts = inter.groupBy("username").agg(F.count(F.when(F.col("rating") != 0, 1)).alias("n"))
    users = F.broadcast(counts.agg((F.count("*") < 10).alias("few")))  # one row
    wm = F.when(F.col("few") | (F.col("n") < 20), 0.7).otherwise(0.6)
    return counts.crossJoin(users).select("username", wm.alias("wm"), F.round(1 - wm, 1).alias("wc"))


def recommend_hybrid(
    meta: DataFrame, collab: DataFrame, inter: DataFrame, n: int = 10, wm: float | None = None, wc: float | None = None, attrs: DataFrame | None = None, most: int = 2,
) -> DataFrame:
    """(username, rank, slug, score) from the 2n best of either side. Without weights each user's own are taken, see
    hybrid_weights(); one given weight makes the other what is missing to 1, or zero. attrs, where given, let no director
    have more than `most` films."""
    own = hybrid_weights(inter) if wm is None and wc is None else None
    if own is None:
        wm, wc = (max(0.0, 1 - wc) if wm is None else wm), (max(0.0, 1 - wm) if wc is None else wc)
    best = lambda df: top_n(df.select("username", "slug", "score"), 2 * n).drop("rank")
    fused = fuse_normalized(best(meta), best(collab), *(() if own is not None else (wm, wc)), own=own)
    if attrs is None:
        return top_n(fused, n).select("username", "rank", "slug", "score")
    whole = fused.withColumn("rank", F.row_number().over(Window.partitionBy("username").orderBy(F.desc("score"), "slug")))
    return diversify(whole, attrs, n, most).join(fused, ["username", "slug"]).select("username", "rank", "slug", "score")
