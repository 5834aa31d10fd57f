"""Metadata scores: every rule is a product of a user's and a film's vector over values of one kind."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palate.operators.blocks import best_unseen, every_pair
from palate.operators.pairs import Columns, best_in_rows, meet, ordered_entries
from palate.operators.profile import deep_enough, film_genre_pairs
from palate.sources.shared import shared_table

# Fixed values of the scoring model, by kind: weight, cap of the sum, penalty on negative values, counts for full confidence.
WEIGHT = {"genre": 1.0, "director": 3.0, "actor": 0.5, "theme": 0.4, "language": 1.0, "country": 1.5, "writer": 2.0, "cinematographer": 1.0, "composer": 0.8,
          "pair": 0.6, "decade": 0.3, "momentum": 1.0}
CAP = {"director": 3.0, "genre": 4.0, "actor": 3.0}
PENALTY = {"director": 2.0, "writer": 1.8, "pair": 1.5, "decade": 1.0, "momentum": 1.0}
OTHER_PENALTY = 1.5
FULL_COUNT = {"director": 3, "genre": 5, "actor": 4, "writer": 2, "cinematographer": 2, "composer": 2}
OTHER_FULL_COUNT = 5
IDF_KINDS = ("genre", "director", "country")
FILM_DEPTH = {"actor": 5, "country": 3}
LATER_COUNTRY = 0.3
MOMENTUM = {"director": (0.75, 0.5), "genre": (0.39, 0.4)}
DISLIKED_DIRECTOR, DISLIKED_GENRE = 2.0, 0.5


def by_kind(values: dict, otherwise: float, kind: str = "kind") -> Column:
    out = F.lit(float(otherwise))
    for k, v in values.items():
        out = F.when(F.col(kind) == k, F.lit(float(v))).otherwise(out)
    return out


def user_vectors(
    profile: DataFrame, idf: DataFrame, pairs: DataFrame | None = None, interactions: DataFrame | None = None, momentum: DataFrame | None = None,
    feature_weights: DataFrame | None = None,
) -> DataFrame:
    """(username, kind, value, x): what each value of each kind adds to a film that has it, before cap and weight.

    feature_weights: (attr_type, key, factor) for genres, directors and decades; 1 where there is none."""
    base = profile.select("username", F.col("attr_type").alias("kind"), F.col("attr_value").alias("value"), "score", "n")
    if feature_weights is not None:
        factors = feature_weights.select(F.col("attr_type").alias("kind"), F.col("key").alias("value"), "factor")
        base = base.join(factors, ["kind", "value"], "left").withColumn("score", F.col("score") * F.coalesce("factor", F.lit(1.0))).drop("factor")
    known = idf.filter(F.col("attr_type").isin(*IDF_KINDS)).select(F.col("attr_type").alias("kind"), F.col("attr_value").alias("value"), "idf")
    sure = F.least(F.sqrt(F.col("n") / by_kind(FULL_COUNT, OTHER_FULL_COUNT)), F.lit(1.0))
    x = F.when(F.col("kind") == "decade", F.col("score")).otherwise(F.col("score") * sure * F.coalesce("idf", F.lit(1.0)))
    out = base.join(known, ["kind", "value"], "left").select("username", "kind", "value", x.alias("x"))
    if pairs is not None:
        keyed = lambda df, v: df.select("username", F.concat("a", F.lit("|"), "b").alias("value"), F.col(v).alias(v))
        both = keyed(pairs, "score").join(keyed(interactions, "effect"), ["username", "value"], "full")
        out = out.unionByName(both.select("username", F.lit("pair").alias("kind"), "value", F.coalesce("effect", "score").alias("x")))
    if momentum is not None:
        m = F.col("momentum")
        part = lambda k: F.when(m > 0.3, m * MOMENTUM[k][0]).when(m < -0.3, m * MOMENTUM[k][1])
        x = F.when(F.col("attr_type") == "director", part("director")).otherwise(part("genre"))
        out = out.unionByName(
            momentum.select("username", F.lit("momentum").alias("kind"), F.concat_ws(":", "attr_type", "attr_value").alias("value"), x.alias("x")).filter("x is not null")
        )
    return out.withColumn("x", F.when(F.col("x") < 0, F.col("x") * by_kind(PENALTY, OTHER_PENALTY)).otherwise(F.col("x")))


def film_vectors(attrs: DataFrame) -> DataFrame:
    """(slug, kind, value, y) from attributes with decades: first cast and countries, later countries for less; genre
    pairs, and directors and genres once more for momentum."""
    kind = F.col("attr_type")
    near = attrs.filter(((kind != "actor") | (F.col("pos") <= FILM_DEPTH["actor"])) & ((kind != "country") | (F.col("pos") <= FILM_DEPTH["country"])))
    y = F.when((kind == "country") & (F.col("pos") > 1), LATER_COUNTRY).otherwise(1.0)
    out = near.select("slug", kind.alias("kind"), F.col("attr_value").alias("value"), y.alias("y"))
    pairs = film_genre_pairs(attrs).select("slug", F.lit("pair").alias("kind"), F.concat("a", F.lit("|"), "b").alias("value"), F.lit(1.0).alias("y"))
    moving = attrs.filter("attr_type in ('director', 'genre')").select(
        "slug", F.lit("momentum").alias("kind"), F.concat_ws(":", "attr_type", "attr_value").alias("value"), F.lit(1.0).alias("y")
    )
    return out.unionByName(pairs).unionByName(moving)


def capped(total: Column) -> Column:
    limit = by_kind(CAP, float("inf"))
    return F.greatest(F.least(total, limit), -limit)


def attribute_scores(pairs: DataFrame, users: DataFrame, films: DataFrame) -> DataFrame:
    """(username, slug, kind, score) of given pairs of user and film: sums of products, capped, then weighted."""
    joined = pairs.select("username", "slug").join(films, "slug").join(users, ["username", "kind", "value"])
    sums = joined.groupBy("username", "slug", "kind").agg(F.sum(F.col("x") * F.col("y")).alias("total"))
    return sums.select("username", "slug", "kind", (capped(F.col("total")) * by_kind(WEIGHT, 1.0)).alias("score"))


def community_bonus(avg: Column, mean: Column) -> Column:
    gap = F.abs(avg - mean)
    return F.when(gap < 0.3, 0.8).when(gap < 0.5, 0.4).otherwise(0.0)


def popularity_bonus(count: Column) -> Column:
    """A count over 1,000 never reaches the long-tail bonus, as in the model that this reproduces."""
    return F.when(count > 10_000, 0.06).when(count > 1_000, 0.02).when((count > 0) & (count < 5_000), 0.4).otherwise(0.0)


def negative_profile(inter: DataFrame, attrs: DataFrame) -> DataFrame:
    """(username, attr_type, attr_value): directors and genres of films rated 2 or less; leading cast and themes below 2.5."""
    low = inter.filter("rating < 2.5").select("username", "slug", "rating").join(attrs, "slug")
    strong = F.col("attr_type").isin("director", "genre") & (F.col("rating") <= 2.0)
    mild = ((F.col("attr_type") == "actor") & (F.col("pos") <= 3)) | (F.col("attr_type") == "theme")
    return low.filter(strong | mild).select("username", "attr_type", "attr_value").distinct()


def negative_penalty(pairs: DataFrame, negatives: DataFrame, attrs: DataFrame) -> DataFrame:
    """(username, slug, penalty) for pairs with a disliked director or two disliked genres or more."""
    both = attrs.filter("attr_type in ('director', 'genre')").select("slug", "attr_type", "attr_value")
    met = pairs.select("username", "slug").join(both, "slug").join(negatives, ["username", "attr_type", "attr_value"], "left_semi")
    n = met.groupBy("username", "slug").agg(F.count_if(F.col("attr_type") == "director").alias("d"), F.count_if(F.col("attr_type") == "genre").alias("g"))
    penalty = F.when(F.col("d") > 0, DISLIKED_DIRECTOR).otherwise(0.0) + F.when(F.col("g") >= 2, DISLIKED_GENRE * F.col("g")).otherwise(0.0)
    return n.select("username", "slug", penalty.alias("penalty")).filter("penalty > 0")


Rule = Callable[[DataFrame], Column]


def community_rule(rows: DataFrame) -> Column:
    return community_bonus(F.col("avg_rating"), F.col("weighted_mean"))


def popularity_rule(rows: DataFrame) -> Column:
    return popularity_bonus(F.col("rating_count"))


RULES: tuple[Rule, ...] = (community_rule, popularity_rule)


def score_pairs(pairs: DataFrame, users: DataFrame, films: DataFrame, catalogue: DataFrame, stats: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(username, slug, score) of given pairs: all kinds, and what each rule makes of a pair's row.

    A rule is a function from rows with the catalogue's and the statistics' columns to a column; further kinds of
    attributes only need rows in users and films, whose weights and caps are 1 and none unless by WEIGHT and CAP."""
    sums = attribute_scores(pairs, users, films).groupBy("username", "slug").agg(F.sum("score").alias("attributes"))
    rows = pairs.select("username", "slug").join(catalogue, "slug").join(stats, "username", "left").join(sums, ["username", "slug"], "left")
    score = sum((rule(rows) for rule in rules), F.coalesce("attributes", F.lit(0.0)))
    return rows.select("username", "slug", score.alias("score"))


def top_n(scored: DataFrame, n: int, by: str = "username", what: str = "slug") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("score"), what)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def triage_watchlist(
    inter: DataFrame, users: DataFrame, films: DataFrame, catalogue: DataFrame, stats: DataFrame, negatives: DataFrame, attrs: DataFrame, n: int,
    cold: DataFrame | None = None,
) -> DataFrame:
    """(username, rank, slug, score): each user's own watchlist by metadata score.

    cold: (username, slug, score) for those who have neither rated nor liked a film (cold_users()); they get these instead."""
    pairs = inter.filter("watchlisted").select("username", "slug")
    if cold is not None:
        pairs = pairs.join(cold_users(inter), "username", "left_anti")
    scored = score_pairs(pairs, users, films, catalogue, stats).filter("score > 0")
    scored = scored.join(negative_penalty(pairs, negatives, attrs), ["username", "slug"], "left")
    scored = scored.withColumn("score", F.col("score") - F.coalesce("penalty", F.lit(0.0))).filter("score > 0").drop("penalty")
    scored = scored.withColumn("score", F.round("score", 9))
    if cold is not None:
        scored = scored.unionByName(cold.join(cold_users(inter), "username", "left_semi").select("username", "slug", "score"))
    return top_n(scored, n).select("username", "rank", "slug", "score")


def cold_users(inter: DataFrame) -> DataFrame:
    """(username) of those who have neither rated nor liked a film."""
    return inter.groupBy("username").agg(F.count_if(F.col("rating").isNotNull() | F.col("liked")).alias("n")).filter("n = 0").select("username")


def _people_and_items(users: DataFrame, films: DataFrame, catalogue: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    people = users.groupBy("username").agg(F.collect_list(F.struct("kind", "value", "x")).alias("v"))
    people = people.join(stats.select("username", "weighted_mean"), "username", "left")
    items = films.groupBy("slug").agg(F.collect_list(F.struct("kind", "value", "y")).alias("v"))
    return people, catalogue.select("slug", "avg_rating", "rating_count").join(items, "slug", "left")


def _vocabulary(f: pd.DataFrame) -> dict[str, dict[str, int]]:
    place: dict[str, dict[str, int]] = {}
    for v in f["v"]:
        for p in v if v is not None else ():
            known = place.setdefault(p["kind"], {})
            known.setdefault(p["value"], len(known))
    return place


def _film_matrix(f: pd.DataFrame, place: dict, kind: str) -> np.ndarray:
    out = np.zeros((len(f), len(place[kind])))
    for j, v in enumerate(f["v"]):
        for p in v if v is not None else ():
            if p["kind"] == kind:
                out[j, place[kind][p["value"]]] = p["y"]
    return out


def block_scores(u: pd.DataFrame, f: pd.DataFrame) -> np.ndarray:
    """Each kind as a product of matrices, capped and weighted, and the bonuses."""
    place = _vocabulary(f)
    a = {k: np.zeros((len(u), len(values))) for k, values in place.items()}
    for i, v in enumerate(u["v"]):
        for p in v:
            if p["value"] in place.get(p["kind"], ()):
                a[p["kind"]][i, place[p["kind"]][p["value"]]] = p["x"]
    total = np.zeros((len(u), len(f)))
    for k in sorted(place):
        cap = CAP.get(k, np.inf)
        total += np.clip(a[k] @ _film_matrix(f, place, k).T, -cap, cap) * WEIGHT.get(k, 1.0)
    gap = np.abs(f["avg_rating"].to_numpy(float)[None] - u["weighted_mean"].to_numpy(float)[:, None])
    total += np.where(gap < 0.3, 0.8, np.where(gap < 0.5, 0.4, 0.0))
    count = np.nan_to_num(f["rating_count"].to_numpy(float))
    return total + np.where(count > 10_000, 0.06, np.where(count > 1_000, 0.02, np.where(count > 0, 0.4, 0.0)))[None]


def block_penalties(u: pd.DataFrame, f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """What disliked directors and disliked genres take off; momentum's vocabulary names both."""
    place = _vocabulary(f)
    values = place.get("momentum")
    if not values:
        return np.zeros((len(u), len(f))), np.zeros((len(u), len(f)))
    low = np.zeros((len(u), len(values)))
    for i, d in enumerate(u["disliked"]):
        low[i, [values[x] for x in (d if d is not None else ()) if x in values]] = 1
    b = _film_matrix(f, place, "momentum")
    director = np.array([v.startswith("director:") for v in values])
    d, g = low[:, director] @ b[:, director].T, low[:, ~director] @ b[:, ~director].T
    return np.where(d > 0, DISLIKED_DIRECTOR, 0.0), np.where(g >= 2, DISLIKED_GENRE * g, 0.0)


def recommend_metadata(
    inter: DataFrame, users: DataFrame, films: DataFrame, catalogue: DataFrame, stats: DataFrame, negatives: DataFrame, n: int = 10, hard: bool = False,
    users_at_once: int = 256, films_at_once: int = 4096,
) -> DataFrame:
    """(username, rank, slug, score): for each user the n best films that the user has no record of.

    hard drops a film with a disliked director instead of taking off from its score. Users without a profile get no row."""
    disliked = negatives.filter("attr_type in ('director', 'genre')").select("username", F.concat_ws(":", "attr_type", "attr_value").alias("value")).groupBy("username")
    people, items = _people_and_items(users, films, catalogue, stats)
    people = people.join(inter.groupBy("username").agg(F.collect_set("slug").alias("seen")), "username", "left")
    people = people.join(disliked.agg(F.collect_set("value").alias("disliked")), "username", "left")

    def score(u: pd.DataFrame, f: pd.DataFrame) -> np.ndarray:
        total, (by_director, by_genre) = block_scores(u, f), block_penalties(u, f)
        left = np.where(total > 0, total - by_director - by_genre, 0.0)
        return np.where((left > 0) & ~(hard & (by_director > 0)), left, -np.inf)

    found = best_unseen(people, items, n, score, users_at_once, films_at_once)
    return top_n(found.withColumn("score", F.round("score", 9)), n).select("username", "rank", "slug", "score")


def metadata_scores(users: DataFrame, films: DataFrame, catalogue: DataFrame, stats: DataFrame) -> DataFrame:
    """(username, slug, score) of all users and films."""
    return every_pair(*_people_and_items(users, films, catalogue, stats), block_scores)


def director_gaps(profile: DataFrame, inter: DataFrame, attrs: DataFrame, films: DataFrame, least: float = 2.0, k: int = 3) -> DataFrame:
    """(username, director, rank, slug, score): unseen films of directors that the user likes.

    A director's films are ranked once. Who has seen m of them finds the k best unseen among the first m + k, so no more
    of a director's films meet a user."""
    liked = profile.filter((F.col("attr_type") == "director") & (F.col("score") >= least)).select("username", F.col("attr_value").alias("director"))
    theirs = attrs.filter("attr_type = 'director'").select("slug", F.col("attr_value").alias("director")).distinct()
    score = F.coalesce("avg_rating", F.lit(0.0)) + F.least(F.coalesce("rating_count", F.lit(0)) / 10_000, F.lit(2.0))
    best = Window.partitionBy("director").orderBy(F.desc("score"), "slug")
    ranked = shared_table(theirs.join(films.select("slug", score.alias("score")), "slug").withColumn("place", F.row_number().over(best)), "ranked")
    seen = inter.select("username", "slug").distinct().join(ranked, "slug").join(liked, ["username", "director"], "left_semi").select("username", "director", "slug", "place")
    seen = seen.groupBy("username", "director").agg(F.collect_set("place").alias("seen"))
    asked = liked.join(seen, ["username", "director"], "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<int>")))
    free = F.array_except(F.sequence(F.lit(1), F.size("seen") + k), "seen")
    open_ = asked.select("username", "director", F.posexplode(F.slice(F.array_sort(free), 1, k)).alias("i", "place"))
    rows = open_.join(ranked, ["director", "place"])
    return rows.select("username", "director", (F.col("i") + 1).alias("rank"), "slug", "score")


def similar_films(attrs: DataFrame, films: DataFrame, n: int = 5, fill: DataFrame | None = None) -> DataFrame:
    """(slug, rank, other, score): shared genres, themes and cast count each, a shared director, writer, country or decade once.

    fill: (slug, other, score) of films by another likeness; where fewer than n share anything, its best follow."""
    kinds = deep_enough(attrs).filter("attr_type in ('genre', 'director', 'actor', 'theme', 'country', 'writer')").select("slug", "attr_type", "attr_value")
    decade = (F.floor(F.col("year") / 10) * 10).cast("string")
    kinds = kinds.unionByName(films.filter("year >= 1888").select("slug", F.lit("decade").alias("attr_type"), decade.alias("attr_value")))
    names = ("genre", "director", "actor", "theme", "country", "writer", "decade")
    number = F.coalesce(*[F.when(F.col("attr_type") == k, F.lit(float(i))) for i, k in enumerate(names)])
    entries = kinds.distinct().select(F.col("slug").alias("one"), F.concat_ws(":", "attr_type", "attr_value").alias("what"), number.alias("kind"))

    def choose(one: Columns, other: Columns, sums: list[np.ndarray]) -> tuple:
        met, (genre, director, actor, theme, country, writer, decade) = sums[0] > 0, [np.round(s) for s in sums[1:]]
        score = genre + np.where(director > 0, 5.0, 0.0) + actor * 0.5 + theme * 0.3 + np.where(country > 0, 0.5, 0.0) + np.where(writer > 0, 3.0, 0.0) + np.where(decade > 0, 0.5, 0.0)
        score = np.round(score, 6)
        i, j = best_in_rows(np.where(met, score, -np.inf), n)
        return i, j, score[i, j]

    of = lambda i: lambda c: (c["kind"] == i).astype(float)
    found = meet(ordered_entries(entries), ["kind"], [(of(i), of(i)) for i in range(len(names))], choose, "slug string, other string, score double")
    best = top_n(found, n, "slug", "other").select("slug", "other", "score", F.lit(0).alias("later"))
    if fill is not None:
        more = fill.filter("slug <> other").join(best, ["slug", "other"], "left_anti").select("slug", "other", "score", F.lit(1).alias("later"))
        best = best.unionByName(more)
    w = Window.partitionBy("slug").orderBy("later", F.desc("score"), "other")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("slug", "rank", "other", "score")


def diversity_metrics(recs: DataFrame, attrs: DataFrame) -> DataFrame:
    """(username, diversity, the four entropies of genre, director, first country and decade over log2 of their number,
    how many of each there are, and the years from the first decade to the last)."""
    first = attrs.filter("attr_type in ('genre', 'director', 'decade') or (attr_type = 'country' and pos = 1)")
    counts = recs.select("username", "slug").join(first, "slug").groupBy("username", "attr_type", "attr_value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("username", "attr_type")
    p = F.col("n") / F.sum("n").over(w)
    h = counts.withColumn("p", p).groupBy("username", "attr_type").agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"), F.count("*").alias("values"))
    even = h.withColumn("e", F.when(F.col("values") > 1, F.col("h") / F.log2("values")).otherwise(0.0))
    kinds = ("genre", "director", "country", "decade")
    entropy = [F.coalesce(F.max(F.when(F.col("attr_type") == k, F.col("e"))), F.lit(0.0)).alias(k) for k in kinds]
    number = [F.coalesce(F.max(F.when(F.col("attr_type") == k, F.col("values"))), F.lit(0)).alias(f"n_{k}") for k in kinds]
    wide = even.groupBy("username").agg(*entropy, *number)
    years = counts.filter("attr_type = 'decade'").groupBy("username").agg((F.max(F.col("attr_value").cast("int")) - F.min(F.col("attr_value").cast("int"))).alias("decade_range"))
    wide = wide.join(years, "username", "left").withColumn("decade_range", F.coalesce("decade_range", F.lit(0)))
    return wide.withColumn("diversity", 0.3 * F.col("genre") + 0.3 * F.col("director") + 0.2 * F.col("country") + 0.2 * F.col("decade"))


def diversify(ranked: DataFrame, attrs: DataFrame, n: int, most: int = 2) -> DataFrame:
    """(username, rank, slug): in rank order, skipping a film if any of its directors has `most` films already.

    The order decides, so each user's candidates fold one by one; they are as many as `ranked` has for the user."""
    directors = attrs.filter("attr_type = 'director'").groupBy("slug").agg(F.collect_set("attr_value").alias("directors"))
    rows = ranked.join(directors, "slug", "left").withColumn("directors", F.coalesce("directors", F.array().cast("array<string>")))
    lists = rows.groupBy("username").agg(F.array_sort(F.collect_list(F.struct("rank", "slug", "directors"))).alias("l"))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("used"))

    def step(s: Column, c: Column) -> Column:
        full = F.exists(c["directors"], lambda d: F.size(F.filter(s["used"], lambda x: x == d)) >= most) | (F.size(s["kept"]) >= n)
        return F.when(full, s).otherwise(F.struct(F.concat(s["kept"], F.array(c["slug"])).alias("kept"), F.concat(s["used"], c["directors"]).alias("used")))

    kept = lists.select("username", F.aggregate("l", start, step, lambda s: s["kept"]).alias("kept"))
    return kept.select("username", F.posexplode("kept").alias("p", "slug")).select("username", (F.col("p") + 1).alias("rank"), "slug")
