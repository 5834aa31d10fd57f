"""Queries: sources, filters, catalogue statistics and taste profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from palate.functions import weights as W
from palate.operators import catalogue as C
from palate.operators import profile as P
from palate.plans.registry import ASOF, PARTS, asof, query
from palate.sources.views import Views

BASE = """case when rating >= 4.5 then 2.0 when rating >= 3.5 then 1.0 when rating >= 3.0 then 0.3 when rating >= 2.0 then -0.5
  when rating is not null then -1.5 when liked then 1.5 when watched then 0.4 when watchlisted then 0.2 else 0.0 end::double"""
AGE = f"""case when scraped_at is null or date_sub('day', scraped_at, timestamp '{ASOF}') <= 0 then 1.0
  else greatest(pow(2.0, -date_sub('day', scraped_at, timestamp '{ASOF}') / 730.0), 0.1) end"""
Z = """case when rating is null or dev is null or dev = 0 then {base} when round((rating - mean) / dev, 9) >= 1.5 then 2.0 when round((rating - mean) / dev, 9) >= 0.5 then 1.0
  when round((rating - mean) / dev, 9) >= -0.5 then 0.3 when round((rating - mean) / dev, 9) >= -1.5 then -0.5 else -1.5 end::double""".format(base=BASE)

PARTS["stats"] = "select username, round(avg(rating), 9) as mean, round(stddev_pop(rating), 9) as dev, count(*) as n from interactions where rating is not null group by all"
PARTS["mult"] = """select username, film_slug as slug, max(case when is_favorites then 3.0 when is_ranked and position <= 10 then 2.0
  when is_ranked and position <= 30 then 1.5 when is_ranked then 1.2 else 1.3 end)::double as multiplier from user_lists group by all"""
PARTS["weights"] = f"""select * from (select username, slug, rating, liked, scraped_at, age, base * age * coalesce(multiplier, 1.0) as w
  from (select *, {BASE} as base, {AGE} as age from interactions) left join mult using (username, slug)) where w <> 0"""
PARTS["attrs_d"] = """select * from film_attrs union all select slug, 'decade', cast(year // 10 * 10 as string), 1 from films where year <> 0"""
PARTS["profile"] = """select username, attr_type, attr_value, total / pow(n, case when attr_type = 'actor' then 0.3 else 0.5 end) as score, n from (
  select username, attr_type, attr_value, sum(w * case when attr_type = 'actor' then 0.7 when attr_type = 'theme' then 0.5
    when attr_type = 'country' and pos > 1 then 0.3 else 1.0 end) as total, count(*) as n
  from weights join attrs_d using (slug) where not (attr_type = 'actor' and pos > 5) and not (attr_type = 'theme' and pos > 10) group by all)"""
PARTS["fpairs"] = """select a.slug, a.attr_value as a, b.attr_value as b from film_attrs a join film_attrs b on a.slug = b.slug
  and a.attr_type = 'genre' and b.attr_type = 'genre' and a.attr_value < b.attr_value"""
PARTS["idf"] = """select attr_type, attr_value, count(distinct slug) as doc_count, ln((select count(*) from films) / (1 + count(distinct slug))) as idf
  from film_attrs where attr_type in ('genre', 'director', 'actor', 'theme', 'country', 'language') group by all"""

WEIGHTS = "interactions user_lists mult weights "
PROFILE = WEIGHTS + "films film_attrs attrs_d profile "


def weights_of(v: Views, mode: str = "absolute"):
    return v.once(f"weights_{mode}", lambda: P.weighted(v.interactions, v.user_lists, asof(), mode))


def profile_of(v: Views, mode: str = "absolute"):
    return v.once(f"profile_{mode}", lambda: P.profile_attrs(weights_of(v, mode), P.with_decades(v.film_attrs, v.films)))


def r4(*names: str):
    return [F.round(n, 4).alias(n) for n in names]


# ---- sources ----


@query("read_films", "films", "select slug, title, year, round(avg_rating, 4) as avg_rating, rating_count from films")
def _(v: Views):
    return v.films.select("slug", "title", "year", *r4("avg_rating"), "rating_count")


@query("read_interactions", "interactions", "select username, slug, rating, watched, watchlisted, liked, scraped_at from interactions")
def _(v: Views):
    return v.interactions


@query("read_lists", "user_lists", "select username, list_slug, is_favorites, is_ranked, position, film_slug from user_lists")
def _(v: Views):
    return v.user_lists


@query("upsert_latest", "interactions interactions_dense", """
select username, slug, rating, liked from interactions_dense union all
select username, slug, rating, liked from interactions i where not exists (select 1 from interactions_dense d where d.username = i.username and d.slug = i.slug)""")
def _(v: Views):
    return C.upsert_latest(v.interactions, v.interactions_dense, ["username", "slug"], ["scraped_at"]).select("username", "slug", "rating", "liked")


@query("normalize_attrs", "film_attrs", """
select slug, attr_type, attr_value, row_number() over (partition by slug, attr_type order by pos) as pos from film_attrs where attr_type in ('genre', 'actor', 'country')""")
def _(v: Views):
    lists = v.film_attrs.groupBy("slug").agg(
        *[F.transform(F.array_sort(F.collect_list(F.when(F.col("attr_type") == k, F.struct("pos", "attr_value")))), lambda s: s["attr_value"]).alias(k)
          for k in ("genre", "actor", "country")]
    )
    return C.normalize_attrs(lists, {k: k for k in ("genre", "actor", "country")}).withColumn("pos", F.col("pos").cast("long"))


@query("upsert_follows", "user_follows", "select follower, followee from user_follows union select followee, follower from user_follows")
def _(v: Views):
    return C.upsert_follows(v.user_follows, v.user_follows, both_ways=True)


# ---- filters ----


@query("filter_years", "films", "select slug, year from films where year between 1970 and 1999 or year is null")
def _(v: Views):
    return C.filter_years(v.films, 1970, 1999, nulls="keep").select("slug", "year")


@query("filter_genres", "films film_attrs", """
select slug from films where slug in (select slug from film_attrs where attr_type = 'genre' and attr_value in ('red', 'green', 'small'))
  and slug not in (select slug from film_attrs where attr_type = 'genre' and attr_value in ('blue', 'large'))""")
def _(v: Views):
    return C.filter_genres(v.films, v.film_attrs, ["Red", "green", "small"], ["blue", "LARGE"]).select("slug")


@query("filter_min_rating", "films", "select slug, round(avg_rating, 4) as avg_rating from films where avg_rating >= 2.75 or avg_rating is null")
def _(v: Views):
    return C.filter_min_rating(v.films, 2.75).select("slug", *r4("avg_rating"))


@query("unseen_candidates", "interactions user_lists", """
select distinct username, film_slug as slug from user_lists l where not exists (select 1 from interactions i where i.username = l.username and i.slug = l.film_slug and i.watched)""")
def _(v: Views):
    return C.unseen_candidates(v.user_lists.select("username", F.col("film_slug").alias("slug")).distinct(), v.interactions, only_watched=True)


@query("clean_usernames", "", "select c_custkey, regexp_replace(lower(c_name || ' !' || c_mktsegment), '[^a-z0-9_-]', '', 'g') as username from customer")
def _(v: Views):
    return v.customer.select("c_custkey", C.clean_username(F.concat("c_name", F.lit(" !"), "c_mktsegment")).alias("username"))


@query("clean_slugs", "", """
select p_partkey, case when regexp_full_match(lower(s), '(film:)?[a-z0-9-]+') then lower(s) end as slug from (
  select p_partkey, trim(case when p_partkey % 3 = 0 then ' Film:' || p_partkey when p_partkey % 3 = 1 then p_name else replace(p_name, ' ', '-') end) as s from part)""")
def _(v: Views):
    key = F.col("p_partkey")
    raw = F.when(key % 3 == 0, F.concat(F.lit(" Film:"), key.cast("string"))).when(key % 3 == 1, F.col("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))
    return v.part.select("p_partkey", C.clean_slug(raw).alias("slug"))


@query("active_users", "interactions", "select username, count(*) as n_films, count(rating) as n_rated from interactions group by username having count(*) >= 50 and count(rating) >= 1")
def _(v: Views):
    return C.active_users(v.interactions, 50)


@query("missing_metadata", "interactions films", """
select username, count(distinct slug) as n_missing from interactions where slug not in (select slug from films where rating_count >= 2500) group by username""")
def _(v: Views):
    return C.missing_metadata(v.interactions, v.films.filter("rating_count >= 2500"))


@query("refresh_candidates", "interactions films", "select slug from films where coalesce(rating_count, 0) < 2000 or avg_rating is null union select slug from interactions where slug not in (select slug from films)")
def _(v: Views):
    return C.refresh_candidates(v.interactions, v.films, 2000)


@query("stale_users", "interactions", f"""
select username, max(scraped_at) as last_seen, date_sub('day', max(scraped_at), timestamp '{ASOF}') as age_days from interactions group by username
having date_sub('day', max(scraped_at), timestamp '{ASOF}') >= 100""")
def _(v: Views):
    return C.stale_users(v.interactions, asof(), 100)


# ---- profiles ----


@query("interaction_weight", "interactions", f"select username, slug, {BASE} as weight from interactions")
def _(v: Views):
    return v.interactions.select("username", "slug", W.interaction_weight().alias("weight"))


@query("weight_normalized", "interactions stats", f"select username, slug, round({Z}, 4) as weight from interactions left join stats using (username)")
def _(v: Views):
    return P.with_base_weight(v.interactions, "normalized").select("username", "slug", F.round("base", 4).alias("weight"))


@query("weight_blended", "interactions stats", f"""
select username, slug, round(case when rating is null then {BASE} else b * (case when n >= 10 and dev > 0.2 then {Z} else {BASE} end) + (1 - b) * {BASE} end, 4) as weight
from (select *, 0.5 + 0.4 * least(1.0, n / 50.0) as b from interactions left join stats using (username))""")
def _(v: Views):
    return P.with_base_weight(v.interactions, "blended").select("username", "slug", F.round("base", 4).alias("weight"))


@query("temporal_weight", "interactions", f"select username, slug, round({AGE}, 4) as age_weight from interactions")
def _(v: Views):
    return v.interactions.select("username", "slug", F.round(W.temporal_weight(F.col("scraped_at"), asof()), 4).alias("age_weight"))


@query("list_multiplier", "user_lists mult", "select username, slug, multiplier from mult")
def _(v: Views):
    return P.list_multiplier(v.user_lists)


@query("profile_attrs", PROFILE, "select username, attr_type, attr_value, round(score, 4) as score, n from profile")
def _(v: Views):
    return profile_of(v).select("username", "attr_type", "attr_value", *r4("score"), "n")


@query("profile_decades", PROFILE, "select username, attr_value, round(score, 4) as score, n from profile where attr_type = 'decade'")
def _(v: Views):
    decades = P.with_decades(v.film_attrs.limit(0), v.films)
    return P.profile_attrs(weights_of(v), decades).select("username", "attr_value", *r4("score"), "n")


@query("genre_pairs", WEIGHTS + "film_attrs fpairs", "select username, a, b, round(sum(w) / sqrt(count(*)), 4) as score, count(*) as n from weights join fpairs using (slug) group by all having count(*) >= 2")
def _(v: Views):
    return P.genre_pairs(weights_of(v), v.film_attrs).select("username", "a", "b", *r4("score"), "n")


PARTS["gmeans"] = "select username, attr_value as g, avg(rating) as mean from interactions join film_attrs using (slug) where rating is not null and attr_type = 'genre' group by all"
PARTS["ginter"] = """select p.username, a, b, p.mean - (x.mean + y.mean) / 2 as effect, n from (
  select username, a, b, avg(rating) as mean, count(*) as n from interactions join fpairs using (slug) where rating is not null group by all having count(*) >= 3) p
  join gmeans x on x.username = p.username and x.g = a join gmeans y on y.username = p.username and y.g = b"""


@query("genre_interactions", "interactions film_attrs fpairs gmeans ginter", "select username, a, b, round(effect, 4) as effect, n from ginter")
def _(v: Views):
    return P.genre_interactions(v.interactions, v.film_attrs).select("username", "a", "b", *r4("effect"), "n")


PARTS["momentum"] = f"""select username, attr_type, attr_value, round(case when nr > 2 then sr / nr else 0 end - case when no_ > 2 then so / no_ else 0 end, 9) as momentum from (
  select username, attr_type, attr_value, sum(x) filter (recent) as sr, count(*) filter (recent) as nr, sum(x) filter (not recent) as so, count(*) filter (not recent) as no_ from (
    select *, (rating - 2.5) / 2.5 as x, scraped_at > timestamp '{ASOF}' - interval 180 days as recent from interactions where rating is not null and scraped_at is not null)
  join film_attrs using (slug) where attr_type in ('director', 'genre') group by all) where nr >= 2 and no_ >= 2"""


@query("preference_momentum", "interactions film_attrs momentum", "select username, attr_type, attr_value, round(momentum, 4) as momentum from momentum")
def _(v: Views):
    return P.preference_momentum(v.interactions, v.film_attrs, asof()).select("username", "attr_type", "attr_value", *r4("momentum"))


PARTS["pstats"] = """select username, count(*) as n_films, count(rating) as n_rated, count(*) filter (liked) as n_liked, avg(rating) as mean_rating, stddev_pop(rating) as deviation,
  sum(rating * age) / sum(age) filter (rating is not null) as weighted_mean from weights where slug in (select slug from films) group by all"""


@query("profile_stats", WEIGHTS + "films pstats", "select username, n_films, n_rated, n_liked, round(mean_rating, 4) as mean_rating, round(deviation, 4) as deviation, round(weighted_mean, 4) as weighted_mean from pstats")
def _(v: Views):
    return P.profile_stats(weights_of(v), v.films).select("username", "n_films", "n_rated", "n_liked", *r4("mean_rating", "deviation", "weighted_mean"))


@query("top_preferences", PROFILE, """select username, attr_type, rank, attr_value, round(score, 4) as score from (
  select *, row_number() over (partition by username, attr_type order by round(score, 9) desc, attr_value) as rank from profile) where rank <= 10""")
def _(v: Views):
    return P.top_preferences(profile_of(v).withColumn("score", F.round("score", 9))).select("username", "attr_type", "rank", "attr_value", *r4("score"))


# ---- catalogue ----


@query("attribute_idf", "films film_attrs idf", "select attr_type, attr_value, doc_count, round(idf, 4) as idf from idf")
def _(v: Views):
    return C.attribute_idf(v.film_attrs, v.films).select("attr_type", "attr_value", "doc_count", *r4("idf"))


@query("explore", "films film_attrs", """select attr_value, rank, slug, rating_count from (
  select attr_value, slug, rating_count, row_number() over (partition by attr_value order by rating_count desc, slug) as rank from film_attrs join films using (slug) where attr_type = 'director') where rank <= 5""")
def _(v: Views):
    return C.explore(v.film_attrs, v.films, "director", 5)


@query("db_stats", "interactions films", """select count(distinct username) as n_users, count(*) as n_interactions, count(rating) as n_rated, (select count(*) from films) as n_films,
  count(distinct slug) filter (slug not in (select slug from films)) as n_uncatalogued from interactions""")
def _(v: Views):
    return C.db_stats(v.interactions, v.films)


@query("top_users", "interactions", "select username, count(*) as n_films from interactions group by username order by n_films desc, username limit 5")
def _(v: Views):
    return C.top_users(v.interactions)


@query("social_stats", "user_follows", "select count(*) as n_edges, count(distinct follower) as n_followers, count(distinct followee) as n_followees from user_follows")
def _(v: Views):
    return C.social_stats(v.user_follows)


PARTS["near_follows"] = """select follower, followee from user_follows join customer a on follower = 'u' || a.c_custkey join customer b on followee = 'u' || b.c_custkey
  where a.c_nationkey = b.c_nationkey"""


@query("users_without_social", "interactions user_follows near_follows", """select distinct username from interactions
  where username not in (select follower from near_follows) and username not in (select followee from near_follows)""")
def _(v: Views):
    """Users with records but without a follow edge, either way, in their own nation."""
    nation = v.customer.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("name"), "c_nationkey")
    near = v.user_follows
    for end in ("follower", "followee"):
        near = near.join(nation.select(F.col("name").alias(end), F.col("c_nationkey").alias(f"nation_{end}")), end)
    near = near.filter("nation_follower = nation_followee").select("follower", "followee")
    return C.users_without_social(v.interactions, near)
