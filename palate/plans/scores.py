"""Queries: metadata scores, rankings and what follows from them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palate.operators import catalogue as C
from palate.operators import neighbours as N
from palate.operators import profile as P
from palate.operators import scoring as S
from palate.plans.registry import PARTS, asof, query
from palate.plans.taste import PROFILE, profile_of, r4, weights_of
from palate.sources.views import Views

PARTS["gpairs"] = "select username, a, b, sum(w) / sqrt(count(*)) as score from weights join fpairs using (slug) group by username, a, b having count(*) >= 2"
PARTS["uvec0"] = """
select username, attr_type as kind, attr_value as value, case when attr_type = 'decade' then score else score * least(sqrt(n / (case attr_type when 'director' then 3
   when 'genre' then 5 when 'actor' then 4 when 'writer' then 2 when 'cinematographer' then 2 when 'composer' then 2 else 5 end)), 1.0) * coalesce(i.idf, 1.0) end as x
 from profile left join (select * from idf where attr_type in ('genre', 'director', 'country')) i using (attr_type, attr_value)
union all select username, 'pair', a || '|' || b, coalesce(effect, score) from gpairs full join (select username, a, b, effect from ginter) using (username, a, b)
union all select username, 'momentum', attr_type || ':' || attr_value, case when attr_type = 'director' then case when momentum > 0.3 then momentum * 0.75 when momentum < -0.3 then momentum * 0.5 end
  else case when momentum > 0.3 then momentum * 0.39 when momentum < -0.3 then momentum * 0.4 end end from momentum where abs(momentum) > 0.3"""
PARTS["uvec"] = """select username, kind, value, case when x < 0 then x * (case kind when 'director' then 2.0 when 'writer' then 1.8 when 'decade' then 1.0 when 'momentum' then 1.0
  else 1.5 end) else x end as x from uvec0"""
PARTS["fvec"] = """
select slug, attr_type as kind, attr_value as value, case when attr_type = 'country' and pos > 1 then 0.3 else 1.0 end as y from attrs_d
  where not (attr_type = 'actor' and pos > 5) and not (attr_type = 'country' and pos > 3)
union all select slug, 'pair', a || '|' || b, 1.0 from fpairs
union all select slug, 'momentum', attr_type || ':' || attr_value, 1.0 from film_attrs where attr_type in ('director', 'genre')"""
PARTS["neg"] = """select distinct username, attr_type, attr_value from interactions join film_attrs using (slug) where (rating <= 2.0 and attr_type in ('director', 'genre'))
  or (rating < 2.5 and ((attr_type = 'actor' and pos <= 3) or attr_type = 'theme'))"""
KIND_SCORE = """least(greatest(sum(x * y), -(case kind when 'director' then 3.0 when 'genre' then 4.0 when 'actor' then 3.0 else 1e300 end)),
  case kind when 'director' then 3.0 when 'genre' then 4.0 when 'actor' then 3.0 else 1e300 end) * (case kind when 'director' then 3.0 when 'actor' then 0.5 when 'theme' then 0.4
  when 'country' then 1.5 when 'writer' then 2.0 when 'composer' then 0.8 when 'pair' then 0.6 when 'decade' then 0.3 else 1.0 end)"""
PARTS["wl"] = "select username, slug from interactions where watchlisted"
PARTS["wl_kinds"] = f"select username, slug, kind, {KIND_SCORE} as score from wl join fvec using (slug) join uvec using (username, kind, value) group by username, slug, kind"
BONUS = """case when abs(avg_rating - weighted_mean) < 0.3 then 0.8 when abs(avg_rating - weighted_mean) < 0.5 then 0.4 else 0 end
  + case when rating_count > 10000 then 0.06 when rating_count > 1000 then 0.02 when rating_count > 0 then 0.4 else 0 end"""
PARTS["wl_scores"] = f"""select username, slug, coalesce(s, 0) + {BONUS} as score from wl join films using (slug) left join pstats using (username)
  left join (select username, slug, sum(score) as s from wl_kinds group by all) using (username, slug)"""
FALL = """coalesce((select case when count(*) filter (attr_type = 'director') > 0 then 2.0 else 0 end
  + case when count(*) filter (attr_type = 'genre') >= 2 then 0.5 * count(*) filter (attr_type = 'genre') else 0 end
  from neg join film_attrs a using (attr_type, attr_value) where attr_type in ('director', 'genre') and neg.username = s.username and a.slug = s.slug), 0)"""
SCORES = PROFILE + "pstats idf fpairs gmeans ginter momentum gpairs uvec0 uvec fvec neg "


def vectors_of(v: Views):
    make = lambda: S.user_vectors(profile_of(v), idf_of(v), pairs_of(v), effects_of(v), momentum_of(v))
    return v.once("user_vectors", make), v.once("film_vectors", lambda: S.film_vectors(P.with_decades(v.film_attrs, v.films)))


def kind_of(v: Views, kind: str):
    """The vectors of one of the kinds that need no profile of all attributes: decade, pair or momentum."""
    none = v.film_attrs.limit(0)
    attrs = P.with_decades(none, v.films) if kind == "decade" else none
    profile = P.profile_attrs(weights_of(v), attrs)
    users = S.user_vectors(profile, idf_of(v), *((pairs_of(v), effects_of(v)) if kind == "pair" else (None, None)), momentum_of(v) if kind == "momentum" else None)
    return users, S.film_vectors(attrs if kind == "decade" else v.film_attrs).filter(F.col("kind") == kind)


def idf_of(v: Views):
    return v.once("idf", lambda: C.attribute_idf(v.film_attrs, v.films))


def pairs_of(v: Views):
    return v.once("genre_pairs", lambda: P.genre_pairs(weights_of(v), v.film_attrs))


def effects_of(v: Views):
    return v.once("genre_interactions", lambda: P.genre_interactions(v.interactions, v.film_attrs))


def momentum_of(v: Views):
    return v.once("momentum", lambda: P.preference_momentum(v.interactions, v.film_attrs, asof()))


def stats_of(v: Views):
    return v.once("stats", lambda: P.profile_stats(weights_of(v), v.films))


def negatives_of(v: Views):
    return v.once("negatives", lambda: S.negative_profile(v.interactions, v.film_attrs))


@query("attribute_scores", SCORES + "wl wl_kinds", "select username, slug, kind, round(score, 4) as score from wl_kinds", stored=True)
def _(v: Views):
    return S.attribute_scores(v.interactions.filter("watchlisted"), *vectors_of(v)).select("username", "slug", "kind", *r4("score"))


@query("genre_pair_rule", SCORES + "wl wl_kinds", "select username, slug, round(score, 4) as score from wl_kinds where kind = 'pair'", stored=True)
def _(v: Views):
    return S.attribute_scores(v.interactions.filter("watchlisted"), *kind_of(v, "pair")).select("username", "slug", *r4("score"))


@query("decade_rule", SCORES + "wl wl_kinds", "select username, slug, round(score, 4) as score from wl_kinds where kind = 'decade'", stored=True)
def _(v: Views):
    return S.attribute_scores(v.interactions.filter("watchlisted"), *kind_of(v, "decade")).select("username", "slug", *r4("score"))


@query("momentum_rule", SCORES + "wl wl_kinds", "select username, slug, round(score, 4) as score from wl_kinds where kind = 'momentum'", stored=True)
def _(v: Views):
    return S.attribute_scores(v.interactions.filter("watchlisted"), *kind_of(v, "momentum")).select("username", "slug", *r4("score"))


@query("community_rating_rule", PROFILE + "pstats", """select username, slug, case when abs(avg_rating - weighted_mean) < 0.3 then 0.8 when abs(avg_rating - weighted_mean) < 0.5 then 0.4 else 0 end::double as bonus
  from interactions join films using (slug) left join pstats using (username)""")
def _(v: Views):
    rows = v.interactions.join(v.films, "slug").join(stats_of(v), "username", "left")
    return rows.select("username", "slug", S.community_bonus(F.col("avg_rating"), F.col("weighted_mean")).alias("bonus"))


@query("popularity_rule", "films", "select slug, case when rating_count > 10000 then 0.06 when rating_count > 1000 then 0.02 when rating_count > 0 and rating_count < 5000 then 0.4 else 0 end::double as bonus from films")
def _(v: Views):
    return v.films.select("slug", S.popularity_bonus(F.col("rating_count")).alias("bonus"))


@query("negative_profile", "interactions film_attrs neg", "select username, attr_type, attr_value from neg")
def _(v: Views):
    return S.negative_profile(v.interactions, v.film_attrs)


@query("negative_filter", "interactions film_attrs neg", f"select username, slug, {FALL}::double as penalty from (select username, slug from interactions where watchlisted) s where {FALL} > 0")
def _(v: Views):
    return S.negative_penalty(v.interactions.filter("watchlisted"), S.negative_profile(v.interactions, v.film_attrs), v.film_attrs)


PARTS["tf"] = """select slug, token, c / sum(c) over (partition by slug) as tf from (select slug, lower(attr_value) as token, count(*) as c from film_attrs
  where attr_type in ('genre', 'director', 'theme', 'country', 'language', 'writer') group by all)"""
PARTS["vec0"] = """select slug, token, tf * idf as x from tf join (select token, ln(((select count(distinct slug) from film_attrs) + 1) / (count(*) + 1)) + 1 as idf from tf group by token
  having count(*) >= 2) using (token)"""
PARTS["vec"] = "select slug, token, x / sqrt(sum(x * x) over (partition by slug)) as w from vec0"
PARTS["cold"] = "select username from interactions group by username having count(*) filter (rating is not null or liked) = 0"
PARTS["cold_recs"] = """select username, slug, round(sum(w * c), 9) as score from (select username, slug from interactions semi join cold using (username) where watchlisted) join vec using (slug)
  join (select username, token, c / sqrt(sum(c * c) over (partition by username)) as c from (select username, token, sum(w) as c from interactions semi join cold using (username)
    join vec using (slug) where watched or watchlisted group by all)) using (username, token) group by all having round(sum(w * c), 9) > 0"""


def cold_recs_of(v: Views):
    """Watchlists of users without ratings and likes, by TF-IDF likeness to all that they have."""
    inter = v.interactions
    mine = inter.join(S.cold_users(inter), "username", "left_semi")
    found = N.tfidf_centroid_rank(N.tfidf_vectors(v.film_attrs), mine.filter("watched or watchlisted"), mine.filter("watchlisted"), 10)
    return found.select("username", "slug", "score")


@query("triage_watchlist", SCORES + "wl wl_kinds wl_scores tf vec0 vec cold cold_recs", f"""select username, rank, slug, round(score, 4) as score from (
  select username, slug, score, row_number() over (partition by username order by score desc, slug) as rank from (
    select username, slug, round(score - {FALL}, 9) as score from wl_scores s where score > 0 and username not in (select username from cold) union all select username, slug, score from cold_recs)
  where score > 0) where rank <= 10""", stored=True)
def _(v: Views):
    users, films = vectors_of(v)
    out = S.triage_watchlist(v.interactions, users, films, v.films, stats_of(v), negatives_of(v), v.film_attrs, 10, cold_recs_of(v))
    return out.select("username", "rank", "slug", *r4("score"))


PARTS["all_scores"] = f"""select u.username, f.slug, coalesce(s, 0) + {BONUS} as score from pstats u cross join films f left join (
    select username, slug, sum(score) as s from (select username, slug, kind, {KIND_SCORE} as score from fvec join uvec using (kind, value) group by username, slug, kind) group by all)
  k on k.username = u.username and k.slug = f.slug where not exists (select 1 from interactions i where i.username = u.username and i.slug = f.slug)"""
PARTS["falls"] = """select username, slug, case when count(*) filter (attr_type = 'director') > 0 then 2.0 else 0 end
  + case when count(*) filter (attr_type = 'genre') >= 2 then 0.5 * count(*) filter (attr_type = 'genre') else 0 end as fall
  from neg join film_attrs using (attr_type, attr_value) where attr_type in ('director', 'genre') group by all"""


PARTS["recs"] = """select * from (select username, slug, score, row_number() over (partition by username order by round(score, 9) desc, slug) as rank from (
  select username, slug, round(score - coalesce(fall, 0), 9) as score from all_scores left join falls using (username, slug) where score > 0) where score > 0) where rank <= 10"""


def recommended(v: Views, n: int = 10):
    users, films = vectors_of(v)
    return S.recommend_metadata(v.interactions, users, films, v.films, stats_of(v), negatives_of(v), n)


@query("recommend_metadata", SCORES + "all_scores falls recs", "select username, rank, slug, round(score, 4) as score from recs", stored=True)
def _(v: Views):
    return recommended(v).select("username", "rank", "slug", *r4("score"))


@query("director_gaps", PROFILE, """select username, director, rank, slug, round(score, 4) as score from (select username, attr_value as director, slug, coalesce(avg_rating, 0) + least(coalesce(rating_count, 0) / 10000, 2.0) as score,
  row_number() over (partition by username, attr_value order by coalesce(avg_rating, 0) + least(coalesce(rating_count, 0) / 10000, 2.0) desc, slug) as rank
  from profile p join film_attrs a using (attr_type, attr_value) join films using (slug) where attr_type = 'director' and p.score >= 2
  and not exists (select 1 from interactions i where i.username = p.username and i.slug = a.slug)) where rank <= 3""")
def _(v: Views):
    return S.director_gaps(profile_of(v), v.interactions, v.film_attrs, v.films).select("username", "director", "rank", "slug", *r4("score"))


@query("similar_films", "films film_attrs attrs_d", """select slug, rank, other, score from (select slug, other, score, row_number() over (partition by slug order by score desc, other) as rank from (
  select a.slug, b.slug as other, round(count(*) filter (a.attr_type = 'genre') + case when count(*) filter (a.attr_type = 'director') > 0 then 5.0 else 0 end + count(*) filter (a.attr_type = 'actor') * 0.5
   + count(*) filter (a.attr_type = 'theme') * 0.3 + case when count(*) filter (a.attr_type = 'country') > 0 then 0.5 else 0 end + case when count(*) filter (a.attr_type = 'writer') > 0 then 3.0 else 0 end
   + case when count(*) filter (a.attr_type = 'decade') > 0 then 0.5 else 0 end, 6)::double as score
  from attrs_d a join attrs_d b on a.attr_type = b.attr_type and a.attr_value = b.attr_value and a.slug <> b.slug
  where a.attr_type in ('genre', 'director', 'actor', 'theme', 'country', 'writer', 'decade') and not (a.attr_type = 'actor' and (a.pos > 5 or b.pos > 5)) group by a.slug, b.slug)) where rank <= 5""")
def _(v: Views):
    fill = N.tfidf_rank(N.tfidf_vectors(v.film_attrs), 5).select("slug", "other", "score")
    return S.similar_films(v.film_attrs, v.films, 5, fill)


@query("diversity_metrics", "interactions films film_attrs attrs_d", """
with c as (select username, attr_type, attr_value, count(*) as n from (select username, slug from interactions where liked) join attrs_d using (slug)
   where attr_type in ('genre', 'director', 'decade') or (attr_type = 'country' and pos = 1) group by all),
 p as (select *, n / sum(n) over (partition by username, attr_type) as p from c),
 h as (select username, attr_type, case when count(*) > 1 then -sum(p * log2(p)) / log2(count(*)) else 0 end as e, count(*) as k from p group by all),
 w as (select username, coalesce(max(e) filter (attr_type = 'genre'), 0) as g, coalesce(max(e) filter (attr_type = 'director'), 0) as d, coalesce(max(e) filter (attr_type = 'country'), 0) as c,
   coalesce(max(e) filter (attr_type = 'decade'), 0) as y, coalesce(max(k) filter (attr_type = 'genre'), 0) as n_genre, coalesce(max(k) filter (attr_type = 'director'), 0) as n_director,
   coalesce(max(k) filter (attr_type = 'country'), 0) as n_country, coalesce(max(k) filter (attr_type = 'decade'), 0) as n_decade from h group by username),
 r as (select username, max(attr_value::int) - min(attr_value::int) as decade_range from c where attr_type = 'decade' group by username)
select username, round(g, 4) as genre, round(d, 4) as director, round(c, 4) as country, round(y, 4) as decade, round(0.3 * g + 0.3 * d + 0.2 * c + 0.2 * y, 4) as diversity,
 n_genre, n_director, n_country, n_decade, coalesce(decade_range, 0) as decade_range from w left join r using (username)""".replace("\nwith c", ", c", 1))
def _(v: Views):
    out = S.diversity_metrics(v.interactions.filter("liked"), P.with_decades(v.film_attrs, v.films))
    return out.select("username", *r4("genre", "director", "country", "decade", "diversity"), "n_genre", "n_director", "n_country", "n_decade", "decade_range")


# A greedy choice, film by film in rank order: the state holds what is kept and the directors so far.
@query("diversify", "interactions film_attrs", """, dirs as (select slug, list(distinct attr_value) as ds from film_attrs where attr_type = 'director' group by slug),
 ranked as (select username, slug, row_number() over (partition by username order by rating desc, slug) as rank from interactions where rating is not null),
 rec as (with recursive walk(username, rank, slug, kept, used, taken) as (
   select distinct username, 0::bigint, ''::varchar, 0::bigint, []::varchar[], false from ranked
   union all select w.username, r.rank, r.slug, w.kept + t::bigint, case when t then list_concat(w.used, coalesce(ds, [])) else w.used end, t
   from walk w join (select r.username, r.rank, r.slug, ds from ranked r left join dirs using (slug)) r on r.username = w.username and r.rank = w.rank + 1,
   lateral (select w.kept < 10 and (ds is null or len(list_filter(ds, lambda d: len(list_filter(w.used, lambda x: x = d)) >= 2)) = 0) as t) where w.kept < 10) select * from walk)
select username, kept as rank, slug from rec where taken""")
def _(v: Views):
    whole = F.row_number().over(Window.partitionBy("username").orderBy(F.desc("rating"), "slug"))
    return S.diversify(v.interactions.filter("rating is not null").withColumn("rank", whole), v.film_attrs, 10)
