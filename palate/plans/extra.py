"""Queries: reasons, surprises, bundles, pages and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from palate.operators import catalogue as C
from palate.operators import reasons as R
from palate.plans.registry import PARTS, query
from palate.plans.scores import SCORES, effects_of, idf_of, momentum_of, pairs_of, recommended, stats_of
from palate.plans.social import members_of
from palate.plans.taste import BASE, profile_of, r4
from palate.sources import bundle, pages
from palate.sources.shared import shared_folder
from palate.sources.views import Views
from palate.streaming import jobs

# ---- reasons ----

PARTS["said_values"] = """
select username, slug, attr_type, attr_value, pos, n, p.score as raw, p.score * case when attr_type = 'country' and pos > 1 then 0.3 else 1 end as a, coalesce(i.idf, 1.0) as idf,
 list_position(['genre', 'director', 'actor', 'theme', 'language', 'country', 'writer', 'cinematographer', 'composer'], attr_type) - 1 as i,
 case attr_type when 'genre' then 0.5 when 'director' then 1.0 when 'actor' then 0.5 when 'theme' then 0.0 when 'language' then 0.5 when 'country' then 0.2 when 'writer' then 1.0 else 0.8 end as above,
 case attr_type when 'genre' then -0.3 when 'director' then -0.8 when 'actor' then -0.3 when 'writer' then -0.8 when 'cinematographer' then -0.6 when 'composer' then -0.6 end as below
 from asked join film_attrs using (slug) join profile p using (username, attr_type, attr_value)
 left join (select * from idf where attr_type in ('genre', 'director', 'country')) i using (attr_type, attr_value)
 where not (attr_type = 'actor' and pos > 5) and not (attr_type = 'country' and pos > 3)"""
PARTS["good_values"] = """
select username, slug, i, 0 as j, case attr_type when 'actor' then 'Cast' when 'cinematographer' then 'Cinematography' else upper(attr_type[1]) || attr_type[2:] end || ': ' ||
  case when attr_type = 'director' and f.raw > 1.0 and sqrt(f.n / 3) < 0.7 then f.v || ' (based on ' || f.n || case when f.n > 1 then ' films)' else ' film)' end
   when rare is not null then rare.v || case attr_type when 'genre' then ' (distinctive taste)' when 'director' then ' (distinctive)' else '' end
   when attr_type in ('genre', 'actor') then list_aggregate(list_transform(liked[1:2], lambda x: x.v), 'string_agg', ', ') else liked[1].v end as text
 from (select *, coalesce(rare, liked[1]) as f from (select username, slug, i, attr_type, min({'pos': pos, 'v': attr_value, 'raw': raw, 'n': n}) filter (a > above and idf > 2.0) as rare,
   list({'pos': pos, 'v': attr_value, 'raw': raw, 'n': n} order by pos) filter (a >= 0 and a > above and idf <= 2.0) as liked from said_values group by all)) where f is not null"""
PARTS["bad_values"] = """select username, slug, i, row_number() over (partition by username, slug, i order by pos) as j,
 upper(attr_type[1]) || attr_type[2:] || ': ' || attr_value || ' (disliked)' as text from said_values where a < 0 and a < below"""
PARTS["combos"] = "select username, a, b, coalesce(effect, score) as x from gpairs full join (select username, a, b, effect from ginter) using (username, a, b)"
PARTS["film_combos"] = """select username, slug, p * 1000 + p2 as j, g || '+' || g2 as name, x from asked join (select x.slug, x.attr_value as g, y.attr_value as g2, x.pos as p, y.pos as p2,
   least(x.attr_value, y.attr_value) as a, greatest(x.attr_value, y.attr_value) as b from film_attrs x join film_attrs y on x.slug = y.slug and x.attr_type = 'genre' and y.attr_type = 'genre' and x.pos < y.pos)
  using (slug) join combos using (username, a, b)"""
PARTS["moving"] = """select username, slug, attr_type, attr_value, momentum, case when attr_type = 'director' then 0 else 1000 end + pos as j from asked join film_attrs using (slug) join momentum using (username, attr_type, attr_value)
  where attr_type in ('director', 'genre')"""
PARTS["reasons"] = """
select username, slug, i, j, text from good_values
union all select username, slug, 9, 0, 'Genre combo: ' || (min({'j': j, 'name': name})).name from film_combos where x > 0.5 group by all
union all select username, slug, 10, 0, 'Highly rated (' || round(avg_rating, 1) || '★)' from asked join films using (slug) join pstats using (username) where abs(avg_rating - weighted_mean) < 0.3
union all select username, slug, 11, 0, 'Underseen gem' from asked join films using (slug) where rating_count > 0 and rating_count <= 1000
union all select username, slug, 12, j, text from (select *, row_number() over (partition by username, slug order by j) as r,
  case when attr_type = 'director' then 'Rising interest: ' || attr_value else 'Growing ' || attr_value || ' interest' end as text from moving where momentum > 0.3) where r <= 2"""
PARTS["warnings"] = """
select username, slug, i, j, text from bad_values
union all select username, slug, 9, j, 'Genre combo: ' || name || ' (disliked)' from film_combos where x < -0.5
union all select username, slug, 12, j, text from (select *, row_number() over (partition by username, slug order by j) as r, 'Waning interest: ' || attr_value as text from moving
  where momentum < -0.3 and attr_type = 'director') where r <= 2"""
PARTS["said_reasons"] = """select username, slug, coalesce(rs, []) as reasons, coalesce(ws, []) as warnings from asked
 left join (select username, slug, list(text order by i, j)[1:3] as rs from reasons group by all) using (username, slug)
 left join (select username, slug, list(text order by i, j)[1:2] as ws from warnings group by all) using (username, slug)"""
PARTS["asked"] = "select username, slug from interactions where watchlisted"
REASONS = SCORES + "asked said_values good_values bad_values combos film_combos moving reasons warnings said_reasons "
LINE = "coalesce(list_aggregate({0}, 'string_agg', ' | '), '') as {0}"


def reasons_of(v: Views, asked):
    combos = pairs_of(v).select("username", "a", "b", "score").join(effects_of(v).select("username", "a", "b", "effect"), ["username", "a", "b"], "full")
    combos = combos.select("username", "a", "b", F.coalesce("effect", "score").alias("x"))
    values = R.value_reasons(asked, profile_of(v), v.film_attrs, idf_of(v))
    return R.reasons_warnings(asked, values, R.rule_reasons(asked, v.film_attrs, v.films, stats_of(v), combos, momentum_of(v)))


@query("reasons_warnings", REASONS, f"select username, slug, {LINE.format('reasons')}, {LINE.format('warnings')} from said_reasons", stored=True)
def _(v: Views):
    out = reasons_of(v, v.interactions.filter("watchlisted").select("username", "slug"))
    return out.select("username", "slug", F.array_join("reasons", " | ").alias("reasons"), F.array_join("warnings", " | ").alias("warnings"))


@query("consensus_reasons", REASONS + "groups members", """, r as (select group_id, slug, n_members, split_part(r, ':', 1) as r, count(*) as n from members join said_reasons using (username), unnest(reasons) as t(r) group by all)
select group_id, slug, list_aggregate(list(r || case when n = n_members then ' (all)' else ' (' || n || '/' || n_members || ')' end order by -n, r || case when n = n_members then ' (all)' else ' (' || n || '/' || n_members || ')' end)[1:3],
 'string_agg', ' | ') as reasons from r where n >= n_members / 2 group by group_id, slug""", stored=True)
def _(v: Views):
    said = reasons_of(v, v.interactions.filter("watchlisted").select("username", "slug"))
    return R.consensus_reasons(members_of(v), said).select("group_id", "slug", F.array_join("reasons", " | ").alias("reasons"))


# ---- surprises ----

PARTS["ranked"] = """select * from (select username, slug, score, row_number() over (partition by username order by score desc, slug) as rank from (
  select username, slug, round(score - coalesce(fall, 0), 9) as score from all_scores left join falls using (username, slug) where score > 0) where score > 0) where rank <= 300"""
PARTS["windows"] = """select *, case when e <= s then least(s, total) else s end as low, case when e <= s then total else e end as high from (
  select *, greatest(17, floor(total * 0.2), 50) as s, least(floor(total * 0.8), 300, total) as e from (select *, count(*) over (partition by username) as total from ranked))"""
PARTS["pool"] = "select username, slug, rank from windows where rank > low and rank <= high"
PARTS["counts"] = "select username, attr_type, attr_value, n, avg(n) over (partition by username, attr_type) as mean from profile where attr_type in ('genre', 'country')"
PARTS["fresh"] = """select pool.username, pool.slug, rank, round(coalesce(x, 0) + case when year <> 0 and coalesce(d.score, 0) < 0.5 then 0.5 else 0 end + case when coalesce(rating_count, 0) < 50000 then 0.5 else 0 end, 9) as novelty
 from pool join films on films.slug = pool.slug left join (select username, attr_value::int as dec, score from profile where attr_type = 'decade') d on d.username = pool.username and d.dec = year // 10 * 10
 left join (select username, slug, sum(case when attr_type = 'genre' then case when c < 3 then 1.0 when c < 10 then 0.3 else g end else case when c < 5 then 1.5 else g end end) as x from (
   select p.username, p.slug, a.attr_type, coalesce(k.n, 0) as c, coalesce(greatest(0, 1 - coalesce(k.n, 0) / m.mean) * 0.8, 0) as g from pool p join (select distinct slug, attr_type, attr_value from film_attrs
     where attr_type = 'genre' or (attr_type = 'country' and pos = 1)) a using (slug) left join counts k using (username, attr_type, attr_value)
   left join (select distinct username, attr_type, mean from counts) m on m.username = p.username and m.attr_type = a.attr_type) group by all) x on x.username = pool.username and x.slug = pool.slug
 where avg_rating >= 3.5"""
PARTS["picked"] = """select w.username, w.slug, w.score, w.rank, w.total, least(3, n_pool) as picks, case when r <= least(3, n_pool) then r end as i from windows w
  left join (select username, slug, row_number() over (partition by username order by novelty desc, rank) as r from fresh) f using (username, slug)
  left join (select username, count(*) as n_pool from pool group by all) n using (username)"""
PARTS["placed0"] = """select *, least(20 - picks, total) as core, count(i) over (partition by username) as found from (select * replace (coalesce(picks, 0) as picks) from picked)"""
PARTS["placed"] = """select *, case when i is not null then least(5 * i, core + i - 1) when rank <= core then rank - 1 + (found >= 1 and rank - 1 >= least(5, core))::int
   + (found >= 2 and rank - 1 >= least(10, core + 1) - 1)::int + (found >= 3 and rank - 1 >= least(15, core + 2) - 2)::int end as p from placed0"""


@query("inject_serendipity", SCORES + "all_scores falls ranked windows pool counts fresh picked placed0 placed", """select username, (p + 1)::int as rank, slug, round(score, 4) as score, i is not null as discovery from (
  select * replace (coalesce(p, core + found + row_number() over (partition by username order by p is not null, rank) - 1) as p) from placed) where p < 20""", stored=True)
def _(v: Views):
    ranked = v.once("ranked", lambda: recommended(v, 300))
    out = R.inject_serendipity(ranked, profile_of(v), v.film_attrs, v.films, 20)
    return out.select("username", "rank", "slug", *r4("score"), "discovery")


# ---- catalogue ----


@query("oldest_users", "interactions", "select username, max(scraped_at) as last_seen from interactions group by username order by last_seen, username limit 5")
def _(v: Views):
    return C.oldest_users(v.interactions)


@query("top_genres", "film_attrs", "select attr_value as genre, count(distinct slug) as n_films from film_attrs where attr_type = 'genre' group by all order by n_films desc, genre limit 10")
def _(v: Views):
    return C.top_genres(v.film_attrs)


@query("decode_lists", "", """select p_partkey as id, case when p_partkey % 5 = 0 then [] when split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) then [split_part(p_name, ' ', 1)] else [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)] end as genres from part""")
def _(v: Views):
    """Lists from JSON texts, of which every fifth is broken, empty or null."""
    words = F.array_distinct(F.slice(F.split("p_name", " "), 1, 2))
    bad = F.when(F.col("p_partkey") % 15 == 0, "[not json").when(F.col("p_partkey") % 10 == 0, "")
    text = F.when(F.col("p_partkey") % 5 != 0, F.to_json(words)).otherwise(bad)
    return C.decode_lists(v.part.select(F.col("p_partkey").alias("id"), text.alias("genres")), ["genres"])


def bundled(v: Views, films, inter):
    path = f"{shared_folder(v.spark)}/bundle-{uuid.uuid4().hex}"
    bundle.export_bundle(films, inter, path, F.lit("2001-12-01"))
    return bundle.import_bundle(v.spark, path, films.schema, inter.schema)


FLAGS = "username, slug, rating, watched, watchlisted, liked"


@query("export_bundle", "interactions", f"select {FLAGS}, scraped_at::varchar as scraped_at from interactions where liked")
def _(v: Views):
    """What a bundle of all films and liked interactions gives back."""
    inter = v.interactions.filter("liked").withColumn("scraped_at", F.col("scraped_at").cast("string"))
    return bundled(v, v.films, inter)[1]


@query("import_bundle", "films film_attrs", """select attr_type, attr_value, count(distinct slug) as doc_count, round(ln((select count(*) from films) / (1 + count(distinct slug))), 4) as idf
 from (select * from film_attrs where attr_type in ('actor', 'theme') union all select 'f' || p_partkey, 'genre', split_part(p_name, ' ', 1), 1 from part where p_partkey % 2 = 0) group by all""", stored=True)
def _(v: Views):
    """The idf after a bundle: half the films with one genre each replace what was known of all; casts and themes of others stay."""
    base = v.film_attrs.filter("attr_type in ('actor', 'theme')")
    new = v.part.filter("p_partkey % 2 = 0").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("slug"), F.col("p_name").alias("title"), F.array(F.element_at(F.split("p_name", " "), 1)).alias("genres"))
    old = v.film_attrs.filter("attr_type in ('actor', 'theme')").join(new.select("slug"), "slug", "left_semi").groupBy("slug").agg(
        F.array_sort(F.collect_list(F.when(F.col("attr_type") == "actor", F.struct("pos", "attr_value")))).alias("cast"), F.collect_list(F.when(F.col("attr_type") == "theme", F.col("attr_value"))).alias("themes"))
    new = new.join(old, "slug", "left").select("slug", "title", "genres", F.transform("cast", lambda s: s["attr_value"]).alias("cast"), "themes")
    films, inter = bundled(v, new, v.interactions.limit(0))
    merged = bundle.merge_bundle(v.films.select("slug", "title"), v.interactions, base, films, inter, {"genre": "genres", "actor": "cast", "theme": "themes"})
    return merged[3].select("attr_type", "attr_value", "doc_count", *r4("idf"))


# ---- pages, written by Spark from the tables and read again ----


def item(slug, inner):
    return F.concat(F.lit('<li class="poster-container"><div data-film-slug="'), slug, F.lit('"></div>'), inner, F.lit("</li>"))


@query("extract_user_grid_pages", "interactions", """select username, slug, case when watched then rating end as rating, watched, watchlisted, (watched and liked) as liked from interactions where watched or watchlisted""")
def _(v: Views):
    mark = F.concat(F.when(F.col("rating").isNotNull(), F.concat(F.lit('<span class="rated-'), (F.col("rating") * 2).cast("int").cast("string"), F.lit('"></span>'))).otherwise(""), F.when(F.col("liked"), '<i class="icon-liked"></i>').otherwise(""))
    page = lambda kind, inner: v.interactions.filter(kind).groupBy("username").agg(F.array_join(F.collect_list(item(F.col("slug"), inner)), "\n").alias("html")).withColumn("kind", F.lit("films" if kind == "watched" else kind))  # noqa: E731,E501
    return pages.extract_user_grid_pages(page("watched", mark).unionByName(page("watchlisted", F.lit("")).withColumn("kind", F.lit("watchlist"))))


@query("extract_list_pages", "user_lists", """select username, list_slug, is_ranked, is_favorites, row_number() over (partition by username, list_slug order by coalesce(position, 0), film_slug)::int as position, film_slug from user_lists""")
def _(v: Views):
    """Each list as one page; ranked ones show their numbers."""
    number = F.when(F.col("is_ranked"), F.concat(F.lit('<p class="list-number">'), F.col("position").cast("string"), F.lit(".</p>"))).otherwise("")
    one = F.struct(F.coalesce("position", F.lit(0)).alias("at"), "film_slug", item(F.col("film_slug"), number).alias("t"))
    lists = v.user_lists.groupBy("username", "list_slug").agg(F.array_sort(F.collect_list(one)).alias("items"), F.max("is_favorites").alias("fav"))
    html = lists.select("username", "list_slug", F.when(F.col("fav"), "My favorite ones").otherwise("Others").alias("list_name"), F.lit(1).alias("page"), F.array_join(F.transform("items", lambda s: s["t"]), "\n").alias("html"))
    return pages.extract_list_pages(html)


@query("extract_member_pages", "user_follows", """select follower as page_id, row_number() over (partition by follower order by followee)::int as rank, followee as username from user_follows""")
def _(v: Views):
    link = F.concat(F.lit('<a class="name" href="/'), "followee", F.lit('/">x</a>'))
    html = v.user_follows.groupBy(F.col("follower").alias("page_id")).agg(F.array_join(F.array_sort(F.collect_list(link)), "\n").alias("html"))
    return pages.extract_member_pages(html)


@query("extract_favorite_pages", "user_lists", """select username, 'profile-favorites' as list_slug, false as is_ranked, true as is_favorites, r::int as position, film_slug
 from (select username, film_slug, row_number() over (partition by username order by film_slug) as r from (select distinct username, film_slug from user_lists where is_favorites)) where r <= 4""")
def _(v: Views):
    """Members' pages that show all films of their favourite lists."""
    items = F.array_join(F.transform(F.array_sort(F.collect_set("film_slug")), lambda s: item(s, F.lit(""))), "")
    html = v.user_lists.filter("is_favorites").groupBy("username").agg(items.alias("items"))
    page = F.concat(F.lit('<section class="wide profile-favorites">'), "items", F.lit("</section>"), item(F.lit("other"), F.lit("")))
    return pages.extract_favorite_pages(html.select("username", page.alias("html")))


@query("extract_reviewer_pages", "interactions", """select slug, r::int as rank, username, rating is not null as has_rating, case when rating is not null then strftime(scraped_at, '%Y-%m-%d') end as review_date
 from (select *, row_number() over (partition by slug order by username) as r from interactions where rating is not null or liked) where r <= 50""")
def _(v: Views):
    """Each film's reviewers by name, twenty a page."""
    rows = v.interactions.filter("rating is not null or liked")
    place = F.row_number().over(Window.partitionBy("slug").orderBy("username")) - 1
    date = F.concat(F.lit('<span class="_nobr"><a href="#">'), F.date_format("scraped_at", "yyyy-MM-dd"), F.lit("</a></span>"))
    one = F.concat(F.lit('<li class="film-detail"><a class="context" href="/'), "username", F.lit('/">x</a>'), F.when(F.col("rating").isNotNull(), F.concat(F.lit('<span class="rating rated-8"></span>'), date)).otherwise(""), F.lit("</li>"))
    rows = rows.select("slug", place.alias("place"), one.alias("t")).withColumn("page", F.floor(F.col("place") / 20).cast("int"))
    html = rows.groupBy("slug", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda s: s["t"]), "\n").alias("html"))
    return pages.extract_reviewer_pages(html)


@query("extract_activity_pages", "interactions", "select username, count(*)::int as film_count, count(rating) > 0 as has_ratings, bool_or(liked) as recent_activity from interactions group by username")
def _(v: Views):
    """Members' pages with the number of their films, a rating band if they rate, and a diary entry if they like a film."""
    g = v.interactions.groupBy("username").agg(F.count("*").alias("n"), F.count("rating").alias("rated"), F.bool_or("liked").alias("any"))
    html = F.concat(
        F.lit('<a class="thousands" href="/'), "username", F.lit('/films/"><span>'), F.format_number("n", 0), F.lit("</span><span>Films</span></a>"),
        F.when(F.col("rated") > 0, '<a href="/x/films/ratings/rated/4/">4</a>').otherwise(""),
        F.when(F.col("any"), F.concat(F.lit('<a href="/'), "username", F.lit('/film/one/">One</a>'))).otherwise('<a href="/other/film/one/">One</a>'),
    )
    return pages.extract_activity_pages(g.select("username", html.alias("html")))


@query("extract_film_pages", "films film_attrs", """select slug, title, year, round(avg_rating::decimal(18, 10), 2)::double as avg_rating, rating_count, coalesce(d, '') as director, coalesce(g, '') as genre
 from films left join (select slug, string_agg(attr_value, ',' order by pos) filter (attr_type = 'director') as d, string_agg(lower(attr_value), ',' order by pos) filter (attr_type = 'genre') as g
   from film_attrs where attr_type in ('director', 'genre') group by slug) using (slug)""", stored=True)
def _(v: Views):
    link = F.concat(F.lit('<a href="'), F.when(F.col("attr_type") == "director", "/director/x/").otherwise("/films/genre/x/"), F.lit('">'), "attr_value", F.lit("</a>"))
    links = v.film_attrs.filter("attr_type in ('director', 'genre')").groupBy("slug").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("attr_type", "pos", link.alias("t")))), lambda s: s["t"]), " ").alias("links"))
    rating = F.when(F.col("avg_rating").isNotNull(), F.concat(F.lit('<meta name="twitter:data2" content="'), F.round("avg_rating", 2).cast("string"), F.lit(' out of 5">'))).otherwise("")
    count = F.concat(F.lit('<a href="/film/x/ratings/">'), F.col("rating_count").cast("string"), F.lit("</a>"))
    html = F.concat(F.lit('<h1 class="headline-1">'), "title", F.lit('</h1><small class="number">'), F.col("year").cast("string"), F.lit("</small> "), F.coalesce("links", F.lit("")), rating, count)
    out = pages.extract_film_pages(v.films.join(links, "slug", "left").select("slug", html.alias("html")))
    return out.select("slug", "title", "year", "avg_rating", "rating_count", *[F.array_join(c, ",").alias(c) for c in ("director", "genre")])


# ---- streams: each table as files, one a batch ----


@query("stream_interactions", "interactions", f"select {FLAGS} from interactions")
def _(v: Views):
    """All interactions of the table, older ones of each pair too, upserted batch by batch."""
    base = v.interactions.withColumn("scraped_at", F.col("scraped_at").cast("timestamp_ntz"))
    older = base.withColumn("scraped_at", F.col("scraped_at") - F.make_dt_interval(F.lit(9))).withColumn("rating", F.lit(0.5))
    path, progress = (f"{shared_folder(v.spark)}/{k}-{uuid.uuid4().hex}" for k in ("interactions", "progress"))
    for name, rows in (("old", older), ("new", base)):  # a later run of the stream has the newer rows
        jobs.stream_interactions(jobs.as_stream(rows, 2), path, f"{progress}/{name}", resume=name == "new").awaitTermination()
    return v.spark.read.parquet(path).select(*FLAGS.split(", "))


@query("stream_queue", "discovered", "select distinct username from discovered where username not in (select 'e' || c_custkey from customer where c_custkey % 7 = 0)")
def _(v: Views):
    source = v.discovered.withColumn("discovered_at", F.col("discovered_at").cast("timestamp"))
    known = v.customer.filter("c_custkey % 7 = 0").select(F.concat(F.lit("e"), F.col("c_custkey").cast("string")).alias("username"))
    return jobs.run_to_table(jobs.stream_queue(jobs.as_stream(source), known, "20000 days").select("username"), "append")


@query("stream_idf", "film_attrs", "select attr_type, attr_value, count(*) as doc_count from film_attrs group by all")
def _(v: Views):
    return jobs.run_to_table(jobs.stream_idf(jobs.as_stream(v.film_attrs.select("slug", "attr_type", "attr_value"))), "complete")


@query("stream_profile", "interactions film_attrs", f"""select username, attr_type, attr_value, round(sum(w * case when attr_type = 'actor' then 0.7 when attr_type = 'theme' then 0.5 when attr_type = 'country' and pos > 1 then 0.3 else 1.0 end), 4) as total,
 count(*) as n from (select username, slug, {BASE} as w from interactions) join film_attrs using (slug) where w <> 0 and not (attr_type = 'actor' and pos > 5) and not (attr_type = 'theme' and pos > 10) group by all""", stored=True)
def _(v: Views):
    source = jobs.as_stream(v.interactions.withColumn("scraped_at", F.col("scraped_at").cast("timestamp")))
    sums = jobs.run_to_table(jobs.stream_profile(source, v.film_attrs), "complete")
    out = sums.groupBy("username", "attr_type", "attr_value").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return out.select("username", "attr_type", "attr_value", *r4("total"), "n")


@query("stream_sessions", "", """, e as (select user_id, ts, ts - lag(ts) over (partition by user_id order by ts) as gap from events), s as (select user_id, ts, sum((gap is null or gap >= interval 30 minute)::int) over (partition by user_id order by ts) as k from e)
select user_id, count(*) as n_events from s group by user_id, k""".replace(", e as", "with e as", 1))
def _(v: Views):
    source = v.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return jobs.run_to_table(jobs.stream_sessions(jobs.as_stream(source), delay="20000 days"), "complete").select("user_id", "n_events")


@query("stream_running_idf", "films film_attrs idf", "select attr_type, attr_value, doc_count, round(idf, 4) as idf from idf")
def _(v: Views):
    """All films in three waves: half of them with values of other films, then all as they are, then some once more.
    Films that come again retract what they said, so the last counts are those of the table."""
    kinds = ("genre", "director", "actor", "theme", "country", "language")
    value = F.struct("attr_type", "attr_value")
    said = v.film_attrs.filter(F.col("attr_type").isin(*kinds)).groupBy("slug").agg(F.collect_set(value).alias("values"))
    true = v.films.select("slug").join(said, "slug", "left")
    wrong = F.transform("values", lambda s: F.struct(s["attr_type"].alias("attr_type"), F.concat(s["attr_value"], F.lit(" (old)")).alias("attr_value")))
    waves = [
        true.filter(F.xxhash64("slug") % 2 == 0).select("slug", F.lit(1).cast("long").alias("version"), wrong.alias("values")),
        true.select("slug", F.lit(2).cast("long").alias("version"), "values"),
        true.filter(F.xxhash64("slug") % 3 == 0).select("slug", F.lit(2).cast("long").alias("version"), "values"),
    ]
    return jobs.run_idf(jobs.as_waves(waves)).select("attr_type", "attr_value", "doc_count", *r4("idf"))


def in_order(v: Views):
    """Events in time order, a quarter of their time a batch, and one last event far ahead that closes all windows."""
    source = v.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    last = v.events.agg((F.max("ts").cast("timestamp") + F.expr("interval 400 days")).alias("ts"))
    last = last.select(F.lit(-1).cast(source.schema["user_id"].dataType).alias("user_id"), "ts")
    return jobs.as_waves([*(source.filter(jobs.quarter("ts", v.events) == q) for q in range(4)), last])


@query("stream_rates", "", """select epoch_us(w) as started_us, epoch_us(w) + 3600000000 as ended_us, count(*) as n_events, count(*)::double as per_hour
 from (select time_bucket(interval 1 hour, ts) as w from events) group by w""")
def _(v: Views):
    rows = jobs.run_to_table(jobs.stream_rates(in_order(v)), "append")
    last = F.unix_micros(F.lit(v.events.agg(F.max("ts").cast("timestamp")).first()[0]))
    own = rows.filter(F.unix_micros("started") <= last)
    return own.select(F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "n_events", *r4("per_hour"))


@query("stream_session_rows", "", """with e as (select user_id, ts, ts - lag(ts) over (partition by user_id order by ts) as gap from events),
 s as (select user_id, ts, sum((gap is null or gap >= interval 30 minute)::int) over (partition by user_id order by ts) as k from e),
 g as (select user_id, min(ts) as a, max(ts) + interval 30 minute as b, count(*) as n_events from s group by user_id, k),
 r as (select *, n_events / ((epoch(date_trunc('second', b)) - epoch(date_trunc('second', a))) / 3600) as per_hour from g)
select user_id, epoch_us(a) as started_us, epoch_us(b) as ended_us, n_events, round(per_hour, 4) as per_hour,
  case when n_events = 1 then 'single' when per_hour >= 6 then 'busy' else 'steady' end as status from r""")
def _(v: Views):
    """Sessions as they close, in append mode: events in time order, a file a day, and one last event far ahead that moves
    the watermark past all; start, end, count, rate and status of each."""
    rows = jobs.session_status(jobs.run_to_table(jobs.stream_sessions(in_order(v), delay="2 hours"), "append")).filter("user_id >= 0")
    us = lambda c: F.unix_micros(c)
    return rows.select("user_id", us("started").alias("started_us"), us("ended").alias("ended_us"), "n_events", *r4("per_hour"), "status")
