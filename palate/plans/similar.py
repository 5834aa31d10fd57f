"""Queries: TF-IDF, neighbours, items and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from palate.operators import neighbours as N
from palate.operators import reasons as R
from palate.plans.registry import PARTS, query
from palate.plans.scores import SCORES, recommended
from palate.plans.taste import r4
from palate.sources.views import Views

PARTS["rated"] = "select username, slug, rating, rating - avg(rating) over (partition by username) as c from interactions_dense where rating is not null"
PARTS["cent"] = "select *, c / (case when sum(c * c) over (partition by username) = 0 then 1 else sqrt(sum(c * c) over (partition by username)) end) as u from rated"
PARTS["upairs"] = """select a.username, b.username as other, count(*) as overlap, sum(a.u * b.u) as cosine, avg(1 - abs(a.rating - b.rating) / 4.5) as agreement
  from cent a join cent b on a.slug = b.slug and a.username <> b.username group by a.username, b.username"""
PARTS["neigh"] = """select username, rank, other, score from (select *, row_number() over (partition by username order by score desc, other) as rank from (
  select username, other, round(cosine * least(overlap / 20.0, 1.0) * overlap / (overlap + 10.0), 9) as score from upairs where overlap >= 5) where score > 0) where rank <= 10"""
PARTS["asym"] = """select username, role, rank, other, score from (select *, row_number() over (partition by username, role order by score desc, other) as rank from (
  select p.username, p.other, case when b.n / a.n > 1 then 'influencer' else 'follower' end as role, round(agreement * (case when b.n / a.n > 1 then least(b.n / a.n, 2.0)
    else least(1 / greatest(b.n / a.n, 0.1), 2.0) end) * overlap / 20, 9) as score
  from upairs p join (select username, count(*) as n from rated group by all) a on a.username = p.username join (select username, count(*) as n from rated group by all) b on b.username = p.other)) where rank <= 10"""
PARTS["chosen"] = """select username, other, sim from (select *, row_number() over (partition by username order by sim desc, other) as rank from (
  select username, other, max(score) as sim from (select username, other, score from neigh union all select username, other, score from asym where role = 'influencer') group by all)) where rank <= 10"""
PARTS["isim"] = """select slug, other, sim from (select *, row_number() over (partition by slug order by sim desc, other) as rank from (
  select a.slug, b.slug as other, round(sum(a.c * b.c) / (sqrt(sum(a.c * a.c)) * sqrt(sum(b.c * b.c))), 9) as sim from rated a join rated b on a.username = b.username and a.slug <> b.slug
  where a.slug in (select slug from rated group by slug having count(*) >= 2) and b.slug in (select slug from rated group by slug having count(*) >= 2)
  group by a.slug, b.slug having count(*) >= 2 and sum(a.c * a.c) > 0 and sum(b.c * b.c) > 0) where sim > 0.3) where rank <= 50"""
PARTS["collab"] = """select * from (select username, slug, score, row_number() over (partition by username order by score desc, slug) as rank from (
  select username, slug, round(sum(score), 9) as score from (
    select c.username, i.slug, sum(case when rating is not null then rating - 2.5 when not liked and not watched and not watchlisted then 0.05
        else (case when liked then 1.2 else 0 end) + (case when watched then 0.4 else 0 end) + (case when watchlisted then 0.25 else 0 end) end * sim)
      * (case when max(rating_count) > 0 then greatest(0.1, 1 - 0.15 * ln(1 + max(rating_count)) / ln(100001)) else 1 end) as score
    from chosen c join interactions_dense i on i.username = c.other left join films using (slug) group by c.username, i.slug
    union all select * exclude (rank) from (select username, other as slug, round(sum(sim), 9) as score, row_number() over (partition by username order by round(sum(sim), 9) desc, other) as rank
      from interactions_dense d join isim using (slug) where (rating >= 3.5 or liked) and username not in (select username from chosen group by username having count(*) >= 3)
      and not exists (select 1 from interactions_dense x where x.username = d.username and x.slug = other) group by username, other) where rank <= 40)
  group by username, slug) s where not exists (select 1 from interactions_dense x where x.username = s.username and x.slug = s.slug)) where rank <= 20"""
DENSE = "interactions_dense rated cent upairs "


@query("tfidf_vectors", "film_attrs tf vec0 vec", "select slug, token, round(w, 4) as w from vec")
def _(v: Views):
    return N.tfidf_vectors(v.film_attrs).select("slug", "token", *r4("w"))


@query("tfidf_rank", "film_attrs tf vec0 vec", """select slug, rank, other, round(score, 4) as score from (select *, row_number() over (partition by slug order by score desc, other) as rank from (
  select a.slug, b.slug as other, round(sum(a.w * b.w), 9) as score from vec a join vec b on a.token = b.token and a.slug <> b.slug group by a.slug, b.slug)) where rank <= 5""")
def _(v: Views):
    return N.tfidf_rank(N.tfidf_vectors(v.film_attrs), 5).select("slug", "rank", "other", *r4("score"))


@query("tfidf_centroid_rank", "film_attrs interactions tf vec0 vec", """
, t as (select username, token, sum(w) as c from interactions join vec using (slug) where watched group by all), c as (select username, token, c / sqrt(sum(c * c) over (partition by username)) as c from t)
select username, rank, slug, round(score, 4) as score from (select *, row_number() over (partition by username order by score desc, slug) as rank from (
  select username, slug, round(sum(w * c), 9) as score from (select username, slug from interactions where watchlisted) join vec using (slug) join c using (username, token) group by all) where score > 0) where rank <= 5""", stored=True)
def _(v: Views):
    inter = v.interactions
    return N.tfidf_centroid_rank(N.tfidf_vectors(v.film_attrs), inter.filter("watched"), inter.filter("watchlisted"), 5).select("username", "rank", "slug", *r4("score"))


@query("centered_ratings", "interactions_dense rated cent", "select username, slug, round(c, 9) as c, round(u, 9) as u from cent")
def _(v: Views):
    return N.centered_ratings(v.interactions_dense).select("username", "slug", F.round("c", 9).alias("c"), F.round("u", 9).alias("u"))


@query("user_neighbors", DENSE + "neigh", "select username, rank, other, round(score, 4) as score from neigh", stored=True)
def _(v: Views):
    return N.user_neighbors(v.once("entries", lambda: N.rated_entries(v.interactions_dense))).select("username", "rank", "other", *r4("score"))


@query("asymmetric_neighbors", DENSE + "asym", "select username, role, rank, other, round(score, 4) as score from asym", stored=True)
def _(v: Views):
    return N.asymmetric_neighbors(v.once("entries", lambda: N.rated_entries(v.interactions_dense))).select("username", "role", "rank", "other", *r4("score"))


@query("recommend_collaborative", DENSE + "films neigh asym chosen isim collab", "select username, rank, slug, round(score, 4) as score from collab", stored=True)
def _(v: Views):
    return N.recommend_collaborative(v.interactions_dense, v.films).select("username", "rank", "slug", *r4("score"))


#: What is said of collaborative recommendations: neighbours that like a film, and favourites that are similar.
SAID = """, likes as (
  select username, slug, list('Liked by ' || other order by i)[1:3] as l from (select c.username, i.slug, c.other, row_number() over (partition by c.username, i.slug order by sim desc, c.other) as i
    from chosen c join interactions_dense i on i.username = c.other left join films f using (slug)
    where round(case when rating is not null then rating - 2.5 when not liked and not watched and not watchlisted then 0.05
        else (case when liked then 1.2 else 0 end) + (case when watched then 0.4 else 0 end) + (case when watchlisted then 0.25 else 0 end) end * sim
      * (case when rating_count > 0 then greatest(0.1, 1 - 0.15 * ln(1 + rating_count) / ln(100001)) else 1 end), 9) > 0.5) group by all),
 own as (select d.username, d.slug as anchor, other as slug, sim from interactions_dense d join isim using (slug) where (rating >= 3.5 or liked)
   and d.username not in (select username from chosen group by username having count(*) >= 3)),
 top as (select username, slug from (select username, slug, row_number() over (partition by username order by round(sum(sim), 9) desc, slug) as k from own o
   where not exists (select 1 from interactions_dense x where x.username = o.username and x.slug = o.slug) group by username, slug) where k <= 40),
 alike as (select username, slug, list('Similar to ' || anchor order by sim desc, anchor)[1:3] as a from own join top using (username, slug) group by all)
"""


@query("collaborative_reasons", DENSE + "films neigh asym chosen isim collab", SAID + """select username, rank, slug, array_to_string(list_concat(coalesce(l, []), coalesce(a, []))[1:3], '; ') as reasons
from collab left join likes using (username, slug) left join alike using (username, slug)""", stored=True)
def _(v: Views):
    found = N.recommend_collaborative(v.interactions_dense, v.films, reasons=True)
    return found.select("username", "rank", "slug", F.array_join("reasons", "; ").alias("reasons"))


@query("item_similarity", "interactions_dense rated isim", "select slug, other, round(sim, 4) as sim from isim")
def _(v: Views):
    return N.item_similarity(v.interactions_dense).select("slug", "other", *r4("sim"))


@query("item_recommend", "interactions_dense rated isim", """select username, rank, slug, round(score, 4) as score from (select *, row_number() over (partition by username order by score desc, slug) as rank from (
  select username, other as slug, round(sum(sim), 9) as score from interactions_dense d join isim using (slug) where (rating >= 3.5 or liked)
  and not exists (select 1 from interactions_dense x where x.username = d.username and x.slug = other) group by username, other)) where rank <= 10""", stored=True)
def _(v: Views):
    inter = v.interactions_dense
    return N.item_recommend(N.item_similarity(inter), inter.filter("rating >= 3.5 or liked"), inter, 10).select("username", "rank", "slug", *r4("score"))


ITEM_SAID = """, iown as (select d.username, d.slug as anchor, other as slug, sim from interactions_dense d join isim using (slug) where (rating >= 3.5 or liked)
   and not exists (select 1 from interactions_dense x where x.username = d.username and x.slug = other)),
 irec as (select * from (select *, row_number() over (partition by username order by score desc, slug) as rank from (select username, slug, round(sum(sim), 9) as score from iown group by all)) where rank <= 10),
 ialike as (select username, slug, list('Similar to ' || anchor order by sim desc, anchor)[1:3] as ia from iown join irec using (username, slug) group by all)
"""


def item_recommended(v: Views):
    """Recommendations by similar films, and what is said of them."""
    inter = v.interactions_dense
    sim, anchors = v.once("isim", lambda: N.item_similarity(inter)), inter.filter("rating >= 3.5 or liked")
    found = v.once("item_recs", lambda: N.item_recommend(sim, anchors, inter, 10))
    # only what was recommended is explained
    return found, R.similar_to(anchors, sim, found)


@query("item_reasons", "interactions_dense rated isim", ITEM_SAID + "select username, rank, slug, array_to_string(ia, '; ') as reasons from irec join ialike using (username, slug)", stored=True)
def _(v: Views):
    found, said = item_recommended(v)
    return found.join(said, ["username", "slug"]).select("username", "rank", "slug", F.array_join("reasons", "; ").alias("reasons"))


@query("popularity_debias", "films", "select slug, round(case when rating_count > 0 then greatest(0.1, 1 - 0.15 * ln(1 + rating_count) / ln(100001)) else 1 end, 4) as factor from films")
def _(v: Views):
    return v.films.select("slug", F.round(N.popularity_debias(F.col("rating_count")), 4).alias("factor"))


PARTS["metas"] = "select username, slug, score from recs"
PARTS["fused"] = """select username, slug, round(0.6 * coalesce(m, 0) + 0.4 * coalesce(c, 0) + case when m is not null and c is not null then 0.1 else 0 end, 9) as score from
  (select username, slug, (score - min(score) over w) / (case when max(score) over w = min(score) over w then 1 else max(score) over w - min(score) over w end) as m from metas window w as (partition by username))
  full join (select username, slug, (score - min(score) over w) / (case when max(score) over w = min(score) over w then 1 else max(score) over w - min(score) over w end) as c from collab window w as (partition by username))
  using (username, slug)"""
FUSED = SCORES + "all_scores falls recs " + DENSE + "neigh asym chosen isim collab metas fused"


@query("fuse_normalized", FUSED, "select username, slug, round(score, 4) as score from fused", stored=True)
def _(v: Views):
    return N.fuse_normalized(recommended(v), N.recommend_collaborative(v.interactions_dense, v.films)).select("username", "slug", *r4("score"))


@query("fused_reasons", DENSE + "films neigh asym chosen isim collab", SAID + ITEM_SAID + f""", f as ({PARTS["fused"].replace("from metas", "from irec")}),
 c as (select username, slug, list_concat(coalesce(l, []), coalesce(a, []))[1:3] as said from collab left join likes using (username, slug) left join alike using (username, slug)),
 t as (select username, slug, score, list_concat(coalesce(ia, []), coalesce(said, [])) as t from f left join ialike using (username, slug) left join c using (username, slug))
select username, slug, round(score, 4) as score, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), '; ') as reasons from t""", stored=True)
def _(v: Views):
    """Similar films and similar users fused, with what either side says of a film."""
    found, said = item_recommended(v)
    theirs = v.once("collab_said", lambda: N.recommend_collaborative(v.interactions_dense, v.films, reasons=True))
    fused = N.fuse_normalized(found, theirs).join(R.merge_reasons(said, theirs.select("username", "slug", "reasons")), ["username", "slug"], "left")
    return fused.select("username", "slug", *r4("score"), F.array_join("reasons", "; ").alias("reasons"))


PARTS["recs20"] = PARTS["recs"].replace("rank <= 10", "rank <= 20")
PARTS["hweights"] = """select username, case when count(*) filter (rating <> 0) < 20 or (select count(distinct username) from interactions_dense) < 10 then 0.7 else 0.6 end as wm
  from interactions_dense group by username"""
PARTS["hybrid"] = """select *, row_number() over (partition by username order by score desc, slug) as rank from (
  select username, slug, round(coalesce(wm, 0.6) * coalesce(m, 0) + (1 - coalesce(wm, 0.6)) * coalesce(c, 0) + case when m is not null and c is not null then 0.1 else 0 end, 9) as score from
  (select username, slug, (score - min(score) over w) / (case when max(score) over w = min(score) over w then 1 else max(score) over w - min(score) over w end) as m from recs20 window w as (partition by username))
  full join (select username, slug, (score - min(score) over w) / (case when max(score) over w = min(score) over w then 1 else max(score) over w - min(score) over w end) as c from collab window w as (partition by username))
  using (username, slug) left join hweights using (username))"""
HYBRID = SCORES + "all_scores falls recs20 " + DENSE + "neigh asym chosen isim collab hweights hybrid"


@query("recommend_hybrid", HYBRID, "select username, rank, slug, round(score, 4) as score from hybrid where rank <= 10", stored=True)
def _(v: Views):
    collab = N.recommend_collaborative(v.interactions_dense, v.films)
    return N.recommend_hybrid(recommended(v, 20), collab, v.interactions_dense).select("username", "rank", "slug", *r4("score"))


@query("recommend_hybrid_diverse", HYBRID, """, dirs as (select slug, list(distinct attr_value) as ds from film_attrs where attr_type = 'director' group by slug),
 rec as (with recursive walk(username, rank, slug, kept, used, taken) as (
   select distinct username, 0::bigint, ''::varchar, 0::bigint, []::varchar[], false from hybrid
   union all select w.username, r.rank, r.slug, w.kept + t::bigint, case when t then list_concat(w.used, coalesce(ds, [])) else w.used end, t
   from walk w join (select r.username, r.rank, r.slug, ds from hybrid r left join dirs using (slug)) r on r.username = w.username and r.rank = w.rank + 1,
   lateral (select w.kept < 10 and (ds is null or len(list_filter(ds, lambda d: len(list_filter(w.used, lambda x: x = d)) >= 1)) = 0) as t) where w.kept < 10) select * from walk)
select r.username, kept as rank, r.slug, round(score, 4) as score from rec r join hybrid h on h.username = r.username and h.slug = r.slug where taken""", stored=True)
def _(v: Views):
    """The same with at most one film of each director."""
    collab = N.recommend_collaborative(v.interactions_dense, v.films)
    return N.recommend_hybrid(recommended(v, 20), collab, v.interactions_dense, attrs=v.film_attrs, most=1).select("username", "rank", "slug", *r4("score"))
