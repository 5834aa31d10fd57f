"""Recommendations for groups of users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

APPROVAL = 2.0
WATCHLIST_BOOST = 0.2

#: Group strategies as aggregates of the members' scores.
STRATEGIES = {
    "least_misery": lambda s: F.min(s),
    "most_pleasure": lambda s: F.max(s),
    "average": lambda s: F.avg(s),
    "multiplicative": lambda s: F.when(F.min(s) > 0, F.exp(F.avg(F.log(F.when(s > 0, s))))).otherwise(0.0),
    "fairness": lambda s: F.avg(s) - 0.5 * F.stddev_pop(s),
    "approval": lambda s: F.count_if(s >= APPROVAL) + 0.1 * F.avg(s),
}

# What a group's mean compatibility is called, from 0.8, 0.6, 0.4 and 0.
LABELS = ("Excellent match! 🎬", "Good compatibility", "Some differences to navigate", "Diverse tastes - finding common ground...")


def group_members(groups: DataFrame, inter: DataFrame) -> DataFrame:
    """(group_id, username, weight, n_members) of members with data, in groups of two or more."""
    known = groups.join(inter.select("username").distinct(), "username", "left_semi")
    n = F.count("*").over(Window.partitionBy("group_id"))
    return known.select("group_id", "username", F.coalesce("weight", F.lit(1.0)).alias("weight")).withColumn("n_members", n).filter("n_members >= 2")


def parse_weight(text: Column) -> tuple[Column, Column]:
    """user:weight as (user, weight); null where it doesn't read so."""
    user = F.regexp_replace(F.lower(F.substring_index(text, ":", 1)), "[^a-z0-9_-]", "")
    weight = F.when(F.instr(text, ":") > 0, F.try_to_number(F.trim(F.substring_index(text, ":", -1)), F.lit("999999.999")).cast("double"))
    return F.when(weight.isNotNull(), user), weight


def group_consensus(members: DataFrame, profile: DataFrame) -> DataFrame:
    """(group_id, attr_type, attr_value, verdict, score): genres that all members know, directors that two know; consensus
    with the least score if all like it, divisive where likes and dislikes are strong."""
    rows = members.join(profile.filter("attr_type in ('genre', 'director')"), "username").withColumn("s", F.col("score") * F.col("weight"))
    g = rows.groupBy("group_id", "attr_type", "attr_value").agg(F.count("*").alias("n"), F.max("n_members").alias("m"), F.min("s").alias("low"), F.max("s").alias("high"))
    genre = F.col("attr_type") == "genre"
    g = g.filter((genre & (F.col("n") == F.col("m"))) | (~genre & (F.col("n") >= 2)))
    split = F.when(genre, (F.col("high") > 1) & (F.col("low") < -0.5)).otherwise((F.col("high") > 2) & (F.col("low") < -1))
    verdict = F.when(F.col("low") > 0, "consensus").when(split, "divisive")
    return g.withColumn("verdict", verdict).filter("verdict is not null").select("group_id", "attr_type", "attr_value", "verdict", F.when(F.col("verdict") == "consensus", F.col("low")).alias("score"))


def shared_watchlist(members: DataFrame, inter: DataFrame, least: int = 2) -> DataFrame:
    rows = members.join(inter.filter("watchlisted").select("username", "slug"), "username")
    return rows.groupBy("group_id", "slug").agg(F.count("*").alias("n_watchlists")).filter(F.col("n_watchlists") >= least)


def pairwise_compatibility(members: DataFrame, profile: DataFrame) -> DataFrame:
    """(group_id, username, other, compatibility): the mean of agreement on common genres, on common directors and the
    cosine of decades scaled to 0..1, of those that there are; 0.5 without any."""
    kinds = profile.filter("attr_type in ('genre', 'director', 'decade')").select("username", "attr_type", "attr_value", "score")
    norm = kinds.filter("attr_type = 'decade'").groupBy("username").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
    norm = norm.withColumn("norm", F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm")))
    pairs = members.select("group_id", "username").join(members.select("group_id", F.col("username").alias("other")), "group_id").filter("username < other")
    theirs = kinds.select(F.col("username").alias("other"), "attr_type", "attr_value", F.col("score").alias("score2"))
    met = pairs.join(kinds, "username").join(theirs, ["other", "attr_type", "attr_value"])
    one = lambda k: F.avg(F.when(F.col("attr_type") == k, ((F.col("score") > 0) == (F.col("score2") > 0)).cast("double")))
    sums = met.groupBy("group_id", "username", "other").agg(
        one("genre").alias("g"), one("director").alias("d"), F.sum(F.when(F.col("attr_type") == "decade", F.col("score") * F.col("score2"))).alias("dot")
    )
    joined = pairs.join(sums, ["group_id", "username", "other"], "left").join(norm, "username", "left").join(norm.select(F.col("username").alias("other"), F.col("norm").alias("norm2")), "other", "left")
    joined = joined.withColumn("y", (F.col("dot") / (F.col("norm") * F.col("norm2")) + 1) / 2)
    parts = F.array_compact(F.array("g", "d", "y"))
    mean = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)).otherwise(0.5)
    return joined.select("group_id", "username", "other", mean.alias("compatibility"))


def explain_group(compat: DataFrame) -> DataFrame:
    """(group_id, overall, label, best_pair, challenging_pair)."""
    pair = F.concat("username", F.lit(" & "), "other")
    g = compat.withColumn("c", F.round("compatibility", 9)).groupBy("group_id").agg(
        F.avg("c").alias("overall"), F.max(F.struct("c", pair.alias("p"))).alias("best"), F.min(F.struct("c", pair.alias("p"))).alias("worst")
    )
    label = F.when(F.col("overall") >= 0.8, LABELS[0]).when(F.col("overall") >= 0.6, LABELS[1]).when(F.col("overall") >= 0.4, LABELS[2]).otherwise(LABELS[3])
    return g.select("group_id", "overall", label.alias("label"), F.col("best.p").alias("best_pair"), F.when(F.col("worst.c") < 0.4, F.col("worst.p")).alias("challenging_pair"))


def group_hint(compat: DataFrame, consensus: DataFrame, shared: DataFrame) -> DataFrame:
    """(group_id, hint): what a group may do, by its overall compatibility, divisive genres and shared watchlist."""
    overall = compat.groupBy("group_id").agg(F.avg(F.round("compatibility", 9)).alias("overall"))
    split = consensus.filter("verdict = 'divisive' and attr_type = 'genre'").groupBy("group_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("attr_value")), 1, 2), ", ").alias("split"))
    some = shared.select("group_id").distinct().withColumn("some", F.lit(True))
    rows = overall.join(split, "group_id", "left").join(some, "group_id", "left")
    hint = F.when(F.col("overall") >= 0.7, "aligned tastes: be adventurous").when(F.col("split").isNotNull(), F.concat(F.lit("consider avoiding "), "split"))
    return rows.select("group_id", hint.when(F.col("some"), "start with the shared watchlist").otherwise("stick to well-rated films").alias("hint"))


def parse_members(texts: DataFrame, group: str = "group_id", text: str = "text") -> DataFrame:
    """(group_id, username, weight) from texts such as "ann, bob:2": names are cleaned, a weight that doesn't read counts 1."""
    rows = texts.select(F.col(group).alias("group_id"), F.explode(F.split(text, ",")).alias("t")).withColumn("t", F.trim("t"))
    name = F.regexp_replace(F.lower(F.substring_index("t", ":", 1)), "[^a-z0-9_-]", "")
    return rows.select("group_id", name.alias("username"), F.coalesce(parse_weight(F.col("t"))[1], F.lit(1.0)).alias("weight")).filter("username <> ''").dropDuplicates(["group_id", "username"])


def aggregate_scores(scores: DataFrame, strategy: str, by: tuple[str, ...] = ("group_id", "slug")) -> DataFrame:
    return scores.groupBy(*by).agg(STRATEGIES[strategy](F.col("score")).alias("group_score"))


def agreement(scores: DataFrame) -> DataFrame:
    """(group_id, slug, agreement, unanimous, controversial, n_against): how far the members' scores lie apart."""
    s = F.col("score")
    g = scores.groupBy("group_id", "slug").agg(F.min(s).alias("low"), F.max(s).alias("high"), F.var_pop(s).alias("v"), F.count_if(s < 0).alias("n_against"))
    spread = (F.col("high") - F.col("low")) * (F.col("high") - F.col("low")) / 4
    even = F.when(spread > 0, 1 - F.col("v") / spread).otherwise(1.0)
    return g.select("group_id", "slug", even.alias("agreement"), (F.col("low") > 0).alias("unanimous"), (F.col("high") - F.col("low") > 3).alias("controversial"), "n_against")


def recommend_group(members: DataFrame, scores: DataFrame, inter: DataFrame, shared: DataFrame, divisive: DataFrame, attrs: DataFrame, strategy: str = "least_misery", n: int = 10) -> DataFrame:
    """(group_id, rank, slug, score) of films that no member has watched and none of whose genres or directors divides.

    scores: (username, slug, score) of the candidates. A shared watchlist multiplies, negative scores too."""
    own = members.join(scores, "username").withColumn("score", F.col("score") * F.col("weight"))
    seen = members.join(inter.filter("watched").select("username", "slug"), "username").select("group_id", "slug").distinct()
    split = divisive.filter("verdict = 'divisive'").join(attrs.select("slug", "attr_type", "attr_value"), ["attr_type", "attr_value"]).select("group_id", "slug").distinct()
    fine = own.join(seen, ["group_id", "slug"], "left_anti").join(split, ["group_id", "slug"], "left_anti")
    total = aggregate_scores(fine, strategy).join(shared, ["group_id", "slug"], "left")
    boosted = F.round(F.col("group_score") * (1 + WATCHLIST_BOOST * F.coalesce("n_watchlists", F.lit(0))), 9)
    w = Window.partitionBy("group_id").orderBy(F.desc("score"), "slug")
    return total.withColumn("score", boosted).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("group_id", "rank", "slug", "score")
