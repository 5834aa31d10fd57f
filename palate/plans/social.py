"""Queries: groups, the graph, the discovery queue, cached profiles and the bias model."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from palate.operators import graph as G
from palate.operators import groups as J
from palate.operators import neighbours as N
from palate.operators import queue as Q
from palate.operators import reasons as R
from palate.operators import scoring as S
from palate.plans import similar  # noqa: F401  its parts come first
from palate.plans.registry import ASOF, PARTS, asof, query
from palate.plans.scores import BONUS, KIND_SCORE, SCORES, idf_of, stats_of, vectors_of
from palate.plans.taste import AGE, PROFILE, profile_of, r4
from palate.sources import models
from palate.sources.shared import shared_folder
from palate.sources.views import Views

# ---- groups ----

PARTS["members"] = """select * from (select group_id, username, weight, count(*) over (partition by group_id) as n_members from groups where username in (select username from interactions)) where n_members >= 2"""
PARTS["cons"] = """select group_id, attr_type, attr_value, verdict, case when verdict = 'consensus' then low end as score from (
  select *, case when low > 0 then 'consensus' when attr_type = 'genre' and high > 1 and low < -0.5 then 'divisive' when attr_type = 'director' and high > 2 and low < -1 then 'divisive' end as verdict from (
    select group_id, attr_type, attr_value, count(*) as n, max(n_members) as m, min(score * weight) as low, max(score * weight) as high from members join profile using (username)
    where attr_type in ('genre', 'director') group by all) where (attr_type = 'genre' and n = m) or (attr_type = 'director' and n >= 2)) where verdict is not null"""
PARTS["shared"] = "select group_id, slug, count(*) as n_watchlists from members join interactions using (username) where watchlisted group by all having count(*) >= 2"
PARTS["compat"] = """select p.group_id, p.username, p.other, coalesce((coalesce(g, 0) + coalesce(d, 0) + coalesce(y, 0)) / nullif((g is not null)::int + (d is not null)::int + (y is not null)::int, 0), 0.5) as compatibility
  from (select a.group_id, a.username, b.username as other from members a join members b on a.group_id = b.group_id and a.username < b.username) p left join (
    select a.username, b.username as other, avg(((a.score > 0) = (b.score > 0))::int) filter (a.attr_type = 'genre') as g, avg(((a.score > 0) = (b.score > 0))::int) filter (a.attr_type = 'director') as d,
      (sum(a.score * b.score) filter (a.attr_type = 'decade') / (max(na.n) * max(nb.n)) + 1) / 2 as y
    from profile a join profile b on a.attr_type = b.attr_type and a.attr_value = b.attr_value and a.username < b.username and a.attr_type in ('genre', 'director', 'decade')
    join members ma on ma.username = a.username join members mb on mb.username = b.username and mb.group_id = ma.group_id
    left join dnorm na on na.username = a.username left join dnorm nb on nb.username = b.username group by a.username, b.username) s on s.username = p.username and s.other = p.other"""
PARTS["dnorm"] = "select username, case when sum(score * score) = 0 then 1 else sqrt(sum(score * score)) end as n from profile where attr_type = 'decade' group by username"
GROUPS = "interactions groups members " + PROFILE.replace("interactions ", "", 1)


def members_of(v: Views):
    return J.group_members(v.groups, v.interactions)


@query("group_members", "interactions groups members", "select group_id, username, weight, n_members from members")
def _(v: Views):
    return members_of(v)


@query("group_consensus", GROUPS + "cons", "select group_id, attr_type, attr_value, verdict, round(score, 4) as score from cons")
def _(v: Views):
    return J.group_consensus(members_of(v), profile_of(v)).select("group_id", "attr_type", "attr_value", "verdict", *r4("score"))


@query("shared_watchlist", "interactions groups members shared", "select group_id, slug, n_watchlists from shared")
def _(v: Views):
    return J.shared_watchlist(members_of(v), v.interactions)


@query("pairwise_compatibility", GROUPS + "dnorm compat", "select group_id, username, other, round(compatibility, 4) as compatibility from compat")
def _(v: Views):
    return J.pairwise_compatibility(members_of(v), profile_of(v)).select("group_id", "username", "other", *r4("compatibility"))


@query("explain_group", GROUPS + "dnorm compat", """select group_id, round(avg(c), 4) as overall, case when avg(c) >= 0.8 then 'Excellent match! 🎬' when avg(c) >= 0.6 then 'Good compatibility'
 when avg(c) >= 0.4 then 'Some differences to navigate' else 'Diverse tastes - finding common ground...' end as label,
  (max({'c': c, 'p': p})).p as best_pair, case when min(c) < 0.4 then (min({'c': c, 'p': p})).p end as challenging_pair
  from (select group_id, round(compatibility, 9) as c, username || ' & ' || other as p from compat) group by group_id""")
def _(v: Views):
    return J.explain_group(J.pairwise_compatibility(members_of(v), profile_of(v))).select("group_id", *r4("overall"), "label", "best_pair", "challenging_pair")


PARTS["mscores"] = "select group_id, slug, rating * weight - 2.5 as score from members join interactions using (username) where rating is not null"


def member_ratings(v: Views):
    """Each member's own rating against the middle of the scale, as a score."""
    rows = members_of(v).join(v.interactions.filter("rating is not null"), "username")
    return rows.select("group_id", "slug", (F.col("rating") * F.col("weight") - 2.5).alias("score"))


@query("aggregate_scores", "interactions groups members mscores", """
select group_id, slug, round(min(score), 4) as least_misery, round(max(score), 4) as most_pleasure, round(avg(score), 4) as average,
 round(case when min(score) > 0 then exp(avg(ln(score)) filter (score > 0)) else 0 end, 4) as multiplicative, round(avg(score) - 0.5 * stddev_pop(score), 4) as fairness,
 round(count(*) filter (score >= 2) + 0.1 * avg(score), 4) as approval from mscores group by all""".replace("ln(score))", "ln(case when score > 0 then score end))"))
def _(v: Views):
    s = F.col("score")
    return member_ratings(v).groupBy("group_id", "slug").agg(*[F.round(f(s), 4).alias(k) for k, f in J.STRATEGIES.items()])


@query("agreement", "interactions groups members mscores", """
select group_id, slug, round(case when max(score) > min(score) then 1 - var_pop(score) / ((max(score) - min(score)) * (max(score) - min(score)) / 4) else 1 end, 4) as agreement,
 min(score) > 0 as unanimous, max(score) - min(score) > 3 as controversial, count(*) filter (score < 0) as n_against from mscores group by all""")
def _(v: Views):
    return J.agreement(member_ratings(v)).select("group_id", "slug", *r4("agreement"), "unanimous", "controversial", "n_against")


PARTS["gpairs_wl"] = "select distinct username, slug from members join shared using (group_id)"
PARTS["gscores0"] = f"""select username, slug, coalesce(s, 0) + {BONUS} as score from gpairs_wl join films using (slug) left join pstats using (username) left join (
  select username, slug, sum(score) as s from (select username, slug, kind, {KIND_SCORE} as score from gpairs_wl join fvec using (slug) join uvec using (username, kind, value) group by username, slug, kind) group by all)
  using (username, slug)"""
PARTS["gseen"] = "select distinct group_id, slug from members join interactions using (username) where watched"
PARTS["gsplit"] = "select distinct group_id, slug from cons join film_attrs using (attr_type, attr_value) where verdict = 'divisive'"
BY_STRATEGY = {
    "least_misery": "min(s)", "most_pleasure": "max(s)", "average": "avg(s)", "multiplicative": "case when min(s) > 0 then exp(avg(ln(case when s > 0 then s end))) else 0 end",
    "fairness": "avg(s) - 0.5 * stddev_pop(s)", "approval": "count(*) filter (s >= 2) + 0.1 * avg(s)",
}


def ranked_groups(scores: str, strategy: str) -> str:
    return f"""select group_id, rank, slug, round(score, 4) as score from (select *, row_number() over (partition by group_id order by score desc, slug) as rank from (
  select group_id, slug, round(g * (1 + 0.2 * coalesce(n_watchlists, 0)), 9) as score from (select group_id, slug, {BY_STRATEGY[strategy]} as g from (
    select group_id, slug, score * weight as s from members join {scores} using (username)) group by all) g left join shared using (group_id, slug)
  where not exists (select 1 from gseen x where x.group_id = g.group_id and x.slug = g.slug) and not exists (select 1 from gsplit x where x.group_id = g.group_id and x.slug = g.slug))) where rank <= 10"""


GROUP_SCORES = "interactions groups members shared " + SCORES.replace("interactions ", "", 1) + "cons gseen gsplit "


def divisive_of(v: Views):
    return v.once("divisive", lambda: J.group_consensus(members_of(v), profile_of(v)))


def shared_of(v: Views):
    return v.once("shared_watchlists", lambda: J.shared_watchlist(members_of(v), v.interactions))


@query("triage_group", GROUP_SCORES + "gpairs_wl gscores0", ranked_groups("gscores0", "least_misery"), stored=True)
def _(v: Views):
    """The members' shared watchlists by what metadata says for each."""
    members, shared = members_of(v), shared_of(v)
    pairs = members.join(shared, "group_id").select("username", "slug").distinct()
    scores = S.score_pairs(pairs, *vectors_of(v), v.films, stats_of(v))
    return J.recommend_group(members, scores, v.interactions, shared, divisive_of(v), v.film_attrs).select("group_id", "rank", "slug", *r4("score"))


PARTS["gscores"] = f"""select u.username, f.slug, coalesce(s, 0) + {BONUS} as score from pstats u cross join films f left join (
    select username, slug, sum(score) as s from (select username, slug, kind, {KIND_SCORE} as score from fvec join uvec using (kind, value) group by username, slug, kind) group by all)
  k on k.username = u.username and k.slug = f.slug where u.username in (select username from members)"""


def group_scores_of(v: Views):
    """Every member's score of every film."""
    users, films = vectors_of(v)
    mine = lambda df: df.join(members_of(v).select("username").distinct(), "username", "left_semi")
    return v.once("member_scores", lambda: S.metadata_scores(mine(users), films, v.films, mine(stats_of(v))))


def group_query(strategy: str) -> None:
    @query(f"recommend_group_{strategy}", GROUP_SCORES + "gscores", ranked_groups("gscores", strategy), stored=True)
    def _(v: Views):
        found = J.recommend_group(members_of(v), group_scores_of(v), v.interactions, shared_of(v), divisive_of(v), v.film_attrs, strategy)
        return found.select("group_id", "rank", "slug", *r4("score"))


for _strategy in J.STRATEGIES:
    group_query(_strategy)


@query("group_hint", GROUPS + "dnorm compat cons shared", """, o as (select group_id, avg(round(compatibility, 9)) as o from compat group by all),
 d as (select group_id, list_aggregate(list_sort(list(distinct attr_value))[1:2], 'string_agg', ', ') as d from cons where verdict = 'divisive' and attr_type = 'genre' group by all)
select group_id, case when o >= 0.7 then 'aligned tastes: be adventurous' when d is not null then 'consider avoiding ' || d when group_id in (select group_id from shared) then 'start with the shared watchlist'
 else 'stick to well-rated films' end as hint from o left join d using (group_id)""", stored=True)
def _(v: Views):
    return J.group_hint(J.pairwise_compatibility(members_of(v), profile_of(v)), divisive_of(v), shared_of(v))


@query("parse_members", "", """select distinct 'g' || (c_custkey // 3) as group_id, 'u' || c_custkey as username, case when c_custkey % 4 = 1 then 2.5 else 1.0 end::double as weight from customer""")
def _(v: Views):
    key = F.col("c_custkey")
    said = F.concat(F.lit("U"), key.cast("string"), F.when(key % 4 == 1, ":2.5").when(key % 4 == 2, ":much").otherwise(""))
    texts = v.customer.groupBy(F.concat(F.lit("g"), F.floor(key / 3).cast("string")).alias("group_id")).agg(F.array_join(F.collect_list(said), ", ").alias("text"))
    return J.parse_members(texts)


# ---- graph ----

PARTS["cls"] = """select username, slug, scraped_at, case when liked then 'liked' when rating >= 4 then 'rated_high' when rating >= 3 then 'rated_mid' when rating is not null then 'rated_low'
  when watchlisted then 'watchlisted' else 'watched' end as edge_type from interactions where slug in (select slug from films)"""
IW = "case edge_type when 'liked' then 0.7 when 'rated_high' then 0.6 when 'rated_mid' then 0.2 when 'watched' then 0.02 when 'watchlisted' then 0.05 else 0 end"
PARTS["edges0"] = f"""
select 'film:' || slug as src, attr_type || ':' || attr_value as dst, attr_type as edge_type, (case attr_type when 'director' then 3.0 when 'writer' then 2.5 when 'cinematographer' then 1.8 when 'composer' then 1.5
  when 'genre' then 1.5 when 'theme' then 1.2 when 'country' then 1.2 when 'language' then 0.8 when 'actor' then 0.7 else 1 end) * greatest(least(coalesce(idf, 1.0), 5.0), 0.1) as weight, true as both_ways
  from film_attrs left join idf using (attr_type, attr_value)
union all select 'film:' || slug, 'decade:' || (year // 10 * 10), 'decade', 1.0, true from films where year <> 0
union all select 'user:' || username, 'film:' || slug, edge_type, {IW} * {AGE}, true from cls
union all select 'user:' || follower, 'user:' || followee, 'follows', 0.3, false from user_follows
union all select 'film:' || slug, 'film:' || other, 'similar_to', sim, false from isim30"""
PARTS["isim30"] = "select slug, other, sim from (select *, row_number() over (partition by slug order by sim desc, other) as r from isim) where r <= 30"
PARTS["edges"] = """select src, dst, edge_type, weight from edges0 where weight > 0
union all select dst, src, case when src like 'user:%' then 'user_bridge' else edge_type end, weight from edges0 where both_ways and weight > 0"""
PARTS["trans"] = """select src, dst, w / (case when sum(w) over (partition by src) = 0 then 1 else sum(w) over (partition by src) end) as p from (select src, dst, sum(weight * (case edge_type when 'rated_high' then 0.9 when 'rated_mid' then 0.6
  when 'rated_low' then 0 when 'watched' then 0.2 when 'watchlisted' then 0.1 when 'user_bridge' then 0.4 when 'director' then 1.2 when 'cinematographer' then 0.9 when 'composer' then 0.8 when 'genre' then 0.8
  when 'theme' then 0.6 when 'country' then 0.7 when 'language' then 0.5 when 'actor' then 0.5 when 'decade' then 0.3 when 'similar_to' then 0.6 when 'follows' then 0.4 else 1 end)) as w from edges group by all)"""
EDGES = "interactions films film_attrs idf user_follows interactions_dense rated isim isim30 cls edges0 edges "


def edges_of(v: Views):
    sim = N.item_similarity(v.interactions_dense, 30)
    return v.once("graph", lambda: G.graph_edges(v.interactions, v.film_attrs, v.films, idf_of(v), asof(), sim, v.user_follows))


@query("graph_edges", EDGES, "select src, dst, edge_type, round(weight, 4) as weight from edges", stored=True)
def _(v: Views):
    return edges_of(v).select("src", "dst", "edge_type", *r4("weight"))


@query("interaction_class", "interactions films cls", "select username, slug, edge_type as class from cls")
def _(v: Views):
    return v.interactions.join(v.films.select("slug"), "slug", "left_semi").select("username", "slug", G.interaction_class().alias("class"))


@query("transition", EDGES + "trans", "select src, dst, round(p, 6) as p from trans", stored=True)
def _(v: Views):
    return G.transition(edges_of(v)).select("src", "dst", F.round("p", 6).alias("p"))


PARTS["rst"] = f"""select username, 'film:' || slug as node, 0.8 * {IW} / sum({IW}) over (partition by username) as mass from cls where {IW} > 0
  union all select username, 'user:' || username, case when username in (select username from cls where {IW} > 0) then 0.2 else 1.0 end from (select distinct username from interactions)"""


@query("restart_distribution", "interactions films cls rst", "select username, node, round(mass, 6) as mass from rst")
def _(v: Views):
    return G.restart_distribution(v.interactions, v.films).select("username", "node", F.round("mass", 6).alias("mass"))


@query("pagerank_step", EDGES + "trans rst", """
select username, node, round(sum(mass), 6) as mass from (select username, dst as node, 0.85 * mass * p as mass from rst join trans on node = src
 union all select username, node, mass * (0.15 + 0.85 * coalesce((select sum(mass) from rst x where x.username = rst.username and x.node not in (select src from trans)), 0)) from rst) group by all""", stored=True)
def _(v: Views):
    restart = restart_of(v)
    return G.one_step(step_of(v), restart, restart).select("username", "node", F.round("mass", 6).alias("mass"))


def step_of(v: Views):
    return v.once("step", lambda: G.transition(edges_of(v)))


def restart_of(v: Views):
    return v.once("restart", lambda: G.restart_distribution(v.interactions, v.films))


@query("personalized_pagerank", stored=True)
def _(v: Views):
    """The whole walk of every user over all nodes, and of its masses the 100 largest; a test holds the walk against a dense matrix."""
    mass = G.personalized_pagerank(step_of(v), restart_of(v)).select("username", "node", F.round("mass", 9).alias("score"))
    return S.top_n(mass, 100, "username", "node").select("username", "rank", "node", F.col("score").alias("mass"))


@query("recommend_graph", stored=True)
def _(v: Views):
    return G.recommend_graph(step_of(v), restart_of(v), v.interactions, v.films).select("username", "rank", "slug", F.round("score", 9).alias("score"))


@query("graph_reasons", "interactions film_attrs", """, have as (select slug, attr_type, attr_value from film_attrs), liked as (select distinct username, attr_type, attr_value from interactions join have using (slug) where liked),
 met as (select username, slug, upper(attr_type[1]) || attr_type[2:] || ': ' || list_aggregate(list_sort(vs)[1:2], 'string_agg', ', ') as t,
   list_position(['director', 'writer', 'cinematographer', 'composer', 'genre', 'actor', 'theme', 'country', 'language'], attr_type) as i
   from (select username, slug, attr_type, list(distinct attr_value) as vs from (select username, slug from interactions where watchlisted) join have using (slug) semi join liked using (username, attr_type, attr_value) group by all))
select username, slug, coalesce(list_aggregate(r, 'string_agg', ' | '), 'High graph relevance from your likes/watchlist') as reasons from (select username, slug from interactions where watchlisted)
 left join (select username, slug, list(t order by i)[1:3] as r from met group by all) using (username, slug)""", stored=True)
def _(v: Views):
    out = R.walk_reasons(v.interactions.filter("watchlisted"), v.interactions, v.film_attrs)
    return out.select("username", "slug", F.array_join("reasons", " | ").alias("reasons"))


@query("explain_paths", stored=True)
def _(v: Views):
    """Paths from liked films to the watchlist; a test holds them against a breadth-first search."""
    liked = v.interactions.filter("liked").select("username", F.col("slug").alias("liked"))
    pairs = v.interactions.filter("watchlisted").select("username", "slug").join(liked, "username")
    return G.explain_paths(edges_of(v).filter("edge_type <> 'follows'"), pairs).select("username", "slug", F.array_join("paths", " | ").alias("paths"))


SOCIAL = "case edge_type when 'rated_high' then 0.9 when 'rated_mid' then 0.6 when 'rated_low' then 0 when 'watched' then 0.2 when 'watchlisted' then 0.1 when 'user_bridge' then 0.6 when 'director' then 1.2 when 'cinematographer' then 0.9 when 'composer' then 0.8 when 'genre' then 0.8 when 'theme' then 0.6 when 'country' then 0.7 when 'language' then 0.5 when 'actor' then 0.5 when 'decade' then 0.3 when 'similar_to' then 0.6 when 'follows' then 1.2 else 1 end"  # noqa: E501


@query("transition_preset", EDGES, f"""select src, dst, round(w / case when sum(w) over (partition by src) = 0 then 1 else sum(w) over (partition by src) end, 6) as p
 from (select src, dst, sum(weight * ({SOCIAL})) as w from edges group by all)""", stored=True)
def _(v: Views):
    return G.transition(edges_of(v), G.relation_weights("social")).select("src", "dst", F.round("p", 6).alias("p"))


@query("transition_budgets", EDGES, """, w as (select src, dst, edge_type, weight * (case edge_type when 'rated_high' then 0.9 when 'rated_mid' then 0.6 when 'rated_low' then 0 when 'watched' then 0.2 when 'watchlisted' then 0.1
   when 'user_bridge' then 0.4 when 'director' then 1.2 when 'cinematographer' then 0.9 when 'composer' then 0.8 when 'genre' then 0.8 when 'theme' then 0.6 when 'country' then 0.7 when 'language' then 0.5
   when 'actor' then 0.5 when 'decade' then 0.3 when 'similar_to' then 0.6 when 'follows' then 0.4 else 1 end) as w from edges),
 t as (select src, edge_type, sum(w) as s, case edge_type when 'director' then 3.0 when 'writer' then 2.5 when 'cinematographer' then 1.8 when 'composer' then 1.5 when 'genre' then 1.5 when 'theme' then 1.2
   when 'country' then 1.2 when 'language' then 0.8 when 'actor' then 0.7 when 'decade' then 0.4 else 1 end as b from w group by all), u as (select *, sum(b) over (partition by src) as bs from t)
select src, dst, round(sum(w * b / bs / case when s = 0 then 1 else s end), 6) as p from w join u using (src, edge_type) group by src, dst""", stored=True)
def _(v: Views):
    return G.transition(edges_of(v), budgets=True).select("src", "dst", F.round("p", 6).alias("p"))


@query("restart_with_seeds", "interactions films cls", f""", w as (select username, slug, {IW} * {AGE} as w from cls where {IW} * {AGE} > 0 union all
  select 'u' || c_custkey, 'f' || (1 + c_custkey % (select count(*) from films)), 0.8 from customer where 'f' || (1 + c_custkey % (select count(*) from films)) in (select slug from films)),
 s as (select username, slug, sum(w) as w from w group by all), every as (select username from interactions union select 'u' || c_custkey from customer)
select username, 'film:' || slug as node, round(0.8 * w / sum(w) over (partition by username), 6) as mass from s
union all select username, 'user:' || username, case when username in (select username from s) then 0.2 else 1.0 end from every""", stored=True)
def _(v: Views):
    """Restart masses by recency, with one seed film for each customer."""
    n = v.films.count()
    seeds = v.customer.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("username"), F.concat(F.lit("f"), (1 + F.col("c_custkey") % n).cast("string")).alias("slug"))
    return G.restart_distribution(v.interactions, v.films, seeds, True, asof()).select("username", "node", F.round("mass", 6).alias("mass"))


@query("reweight_edges", EDGES, """select src, dst, edge_type, round(weight * case edge_type when 'genre' then 2.0 when 'actor' then 0.0 when 'follows' then 1.5 else 1 end, 4) as weight from edges where edge_type <> 'actor'""", stored=True)
def _(v: Views):
    return G.reweight_edges(edges_of(v), {"genre": 2.0, "actor": 0.0, "follows": 1.5}).select("src", "dst", "edge_type", *r4("weight"))


@query("graph_ready_users", "interactions", "select username, count(*) as n_films, count(*) filter (liked) as n_likes, count(*) filter (liked) >= 3 and count(*) >= 20 as ready from interactions group by username")
def _(v: Views):
    return G.graph_ready_users(v.interactions)


# ---- queue ----

#: The queue's own clock, after the last event.
QUEUE_CLOCK = "2030-01-01 00:00:00"

PRIO = "case source_type when 'film_reviews' then 100 when 'taste' then 90 when 'followers' then 80 when 'following' then 80 when 'popular' then 70 else 50 end"
PARTS["pending"] = f"""select username, source_type, discovered_at, {PRIO} as priority from (select *, row_number() over (partition by username order by discovered_at, event_id) as rn from discovered) where rn = 1"""


def pending_of(v: Views):
    none = v.discovered.limit(0)
    return Q.queue_add(v.discovered, none, none)


@query("queue_add", "discovered pending interactions", "select username, source_type, discovered_at, priority from pending where username not in (select username from pending where source_type = 'popular')")
def _(v: Views):
    known = pending_of(v).filter("source_type = 'popular'")
    return Q.queue_add(v.discovered, known, v.interactions)


@query("queue_next", "discovered pending", "select username, source_type, discovered_at, priority from pending order by priority desc, discovered_at, username limit 25")
def _(v: Views):
    return Q.queue_next(pending_of(v), 25)


@query("queue_stats", "discovered pending", "select count(*) as total, count(distinct source_type) as n_sources, round(avg(priority), 4) as mean_priority, round(count(*) * 30 / 3600, 4) as hours from pending")
def _(v: Views):
    return Q.queue_stats(pending_of(v)).select("total", "n_sources", *r4("mean_priority", "hours"))


@query("queue_breakdown", "discovered pending", "select source_type, priority, count(*) as n from pending group by all")
def _(v: Views):
    return Q.queue_breakdown(pending_of(v))


@query("queue_prune_old", "discovered pending", f"select username, source_type, discovered_at, priority from pending where date_sub('day', discovered_at, timestamp '{QUEUE_CLOCK}') < 2200")
def _(v: Views):
    return Q.queue_prune(pending_of(v), F.lit(QUEUE_CLOCK).cast("timestamp_ntz"), days=2200)


@query("queue_prune", "discovered pending", "select username, source_type, discovered_at, priority from pending where not (priority <= 70 and source_type = 'popular')")
def _(v: Views):
    return Q.queue_prune(pending_of(v), asof(), max_priority=70, source="popular")


PARTS["srcs"] = "select source_type as source, max(discovered_at) as refreshed_at, count(*) / 1000.0 as weight, row_number() over (order by source_type) as place from discovered group by source_type"


@query("refill_plan", "discovered srcs", f"""select source, take from (select source, least(want, 150 - coalesce(sum(want) over (order by place rows between unbounded preceding and 1 preceding), 0))::bigint as take from (
  select *, floor(50 * weight) as want from srcs where date_sub('day', refreshed_at, timestamp '{QUEUE_CLOCK}') >= 7 or refreshed_at is null)) where take > 0""")
def _(v: Views):
    g = v.discovered.groupBy("source_type").agg(F.max("discovered_at").alias("refreshed_at"), F.count("*").alias("n"))
    from pyspark.sql import Window

    sources = g.select(F.col("source_type").alias("source"), "refreshed_at", (F.col("n") / 1000.0).alias("weight"), F.row_number().over(Window.orderBy("source_type")).alias("place"))
    return Q.refill_plan(sources, 150, F.lit(QUEUE_CLOCK).cast("timestamp_ntz"))


@query("taste_seeds", "interactions", """select username, candidate, count(*) as n_common from (select username, slug from (select username, slug, row_number() over (partition by username order by rating desc, slug) as r
  from interactions where rating >= 4) where r <= 20) join (select username as candidate, slug from interactions where rating is not null) using (slug) where username <> candidate group by all""")
def _(v: Views):
    return Q.taste_seeds(v.interactions)


@query("stale_sources", "discovered", f"select source_type, max(discovered_at) as last, date_sub('day', max(discovered_at), timestamp '{QUEUE_CLOCK}') as age_days from discovered group by source_type having date_sub('day', max(discovered_at), timestamp '{QUEUE_CLOCK}') >= 30")
def _(v: Views):
    return Q.stale_sources(v.discovered, F.lit(QUEUE_CLOCK).cast("timestamp_ntz"), 30)


# ---- cached profiles ----

PARTS["cached"] = f"""select 'u' || c_custkey as username, timestamp '{ASOF}' - to_days((c_custkey % 12)::int) as updated_at, (3 + c_custkey % 2)::int as schema_version from customer"""
PARTS["said"] = "select username, scraped_at from interactions union all select 'u' || o_custkey, o_orderdate from orders where o_orderpriority <> '5-LOW'"
VALID = f"""select username from cached left join (select username, max(scraped_at) as newest from said group by username) using (username)
  where schema_version = 3 and date_sub('day', updated_at, timestamp '{ASOF}') <= 7 and (newest is null or updated_at >= newest)"""


def cached_of(v: Views):
    key = F.col("c_custkey")
    at = asof() - F.make_dt_interval((key % 12).cast("int"))
    return v.customer.select(F.concat(F.lit("u"), key.cast("string")).alias("username"), at.alias("updated_at"), (3 + key % 2).cast("int").alias("schema_version"))


def list_times(v: Views):
    rows = v.orders.filter("o_orderpriority <> '5-LOW'")
    return rows.select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("username"), F.col("o_orderdate").cast("timestamp_ntz").alias("scraped_at"))


@query("valid_profiles", "interactions said cached", VALID)
def _(v: Views):
    return Q.valid_profiles(cached_of(v), v.interactions, asof(), 3, lists=list_times(v))


def stale_of(v: Views):
    valid = Q.valid_profiles(cached_of(v), v.interactions, asof(), 3, lists=list_times(v))
    return v.interactions.select("username").distinct().join(valid, "username", "left_anti")


@query("stale_profiles", "interactions said cached", f"select distinct username from interactions where username not in ({VALID})")
def _(v: Views):
    return stale_of(v)


@query("refresh_profiles", PROFILE + "said cached", f"""select username, 'genre' as attr_type, 'kept' as attr_value, 1.0::double as score, 1::bigint as n from customer, lateral (select 'u' || c_custkey as username)
   where username not in (select distinct username from interactions where username not in ({VALID}))
 union all select username, attr_type, attr_value, round(score, 4), n from profile where username not in ({VALID})""", stored=True)
def _(v: Views):
    """Cached profiles, here one row a customer, with those of stale users computed anew."""
    name = F.concat(F.lit("u"), F.col("c_custkey").cast("string"))
    cached = v.customer.select(name.alias("username"), F.lit("genre").alias("attr_type"), F.lit("kept").alias("attr_value"), F.lit(1.0).alias("score"), F.lit(1).cast("long").alias("n"))
    out = Q.refresh_profiles(cached, stale_of(v), profile_of(v).select("username", "attr_type", "attr_value", "score", "n"))
    return out.select("username", "attr_type", "attr_value", *r4("score"), "n")


@query("purge_profiles", "cached", "select username, updated_at, schema_version from cached where schema_version = 3")
def _(v: Views):
    return Q.purge_profiles(cached_of(v), 3)


# ---- factors ----

PARTS["matrix"] = "select username, slug, coalesce(rating, case when liked then 4.5 when watched then 3.0 when watchlisted then 2.5 end * 0.3) as value from interactions_dense where rating is not null or liked or watched or watchlisted"


def matrix_of(v: Views):
    return Q.rating_matrix(v.interactions_dense)


@query("rating_matrix", "interactions_dense matrix", "select username, slug, round(value, 4)::double as value from matrix")
def _(v: Views):
    return matrix_of(v).select("username", "slug", *r4("value"))


@query("bias_model", "interactions_dense matrix", """select 'global' as kind, '' as id, round(avg(value), 6) as bias from matrix union all
 select 'user', username, round(avg(value) - (select avg(value) from matrix), 6) from matrix group by username union all select 'item', slug, round(avg(value) - (select avg(value) from matrix), 6) from matrix group by slug""")
def _(v: Views):
    return Q.bias_model(matrix_of(v)).select("kind", "id", F.round("bias", 6).alias("bias"))


@query("svd_diagnostics", "interactions_dense matrix", """with m as (select username, round(avg(value), 9) as m from matrix group by username)
select count(distinct username) as n_users, count(distinct slug) as n_items, count(*) as n_values, round(avg(value), 4) as global_mean,
 (select username from m order by m desc, username desc limit 1) as most_generous, (select username from m order by m, username limit 1) as harshest from matrix""".replace("with m as", ", m as", 1))
def _(v: Views):
    return Q.svd_diagnostics(matrix_of(v)).select("n_users", "n_items", "n_values", *r4("global_mean"), "most_generous", "harshest")


@query("predict_svd")
def _(v: Views):
    matrix = matrix_of(v)
    users, items = Q.fit_svd(matrix, 10)
    return Q.predict_svd(v.interactions_dense.filter("watchlisted").select("username", "slug"), Q.bias_model(matrix), users, items).select("username", "slug", *r4("prediction"))


@query("recommend_svd", stored=True)
def _(v: Views):
    """Unseen films by predicted rating; a test holds factors and ranking against a dense decomposition."""
    matrix = matrix_of(v)
    users, items = Q.fit_svd(matrix, 10)
    return Q.recommend_svd(Q.bias_model(matrix), users, items, v.interactions_dense, v.films).select("username", "rank", "slug", *r4("score"))


@query("model_fingerprint", "interactions_dense matrix", "select count(distinct username) as n_users, count(distinct slug) as n_items, count(*) as n_ratings, 'factors=50' as params from matrix")
def _(v: Views):
    return Q.model_fingerprint(matrix_of(v), factors=50)




@query("predict_als")
def _(v: Views):
    """Predictions of watchlisted films by alternating least squares; a further run on the same matrix loads the stored factors."""
    matrix = v.once("als_matrix", lambda: matrix_of(v))
    path = f"{shared_folder(v.spark)}/models/als-{zlib.crc32(v.sf_dir.encode()):08x}"
    said = Q.model_fingerprint(matrix, factors=10).crossJoin(models.digest(matrix))
    factors = models.stored_model(path, said, lambda: dict(zip(("users", "items"), Q.fit_als(matrix, 10))))
    pairs = v.interactions_dense.filter("watchlisted").select("username", "slug")
    return Q.predict_svd(pairs, Q.bias_model(matrix), factors["users"], factors["items"]).select("username", "slug", *r4("prediction"))
