"""Films, interactions, lists and members from raw HTML pages, by built-in text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Link paths of a film page by kind of attribute.
LINKS = {"director": "/director/", "genre": "/films/genre/", "actor": "/actor/", "theme": "/films/theme/", "country": "/films/country/", "language": "/films/language/",
         "writer": "/writer/", "cinematographer": "/cinematography/", "composer": "/composer/"}
MAX_CAST, SHORT_MINUTES = 10, 40


def unblocked(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages that aren't a captcha or a request to wait."""
    return pages.filter(~F.lower(F.coalesce(F.col(html), F.lit(""))).rlike("captcha|please wait"))


def text_of(html: Column) -> Column:
    plain = F.regexp_replace(html, "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.trim(plain)


def number_of(text: Column) -> Column:
    """12,345 or 1.5M or 26K fans as a whole number; null for anything else."""
    n = F.regexp_extract(text, r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*([KMB]?)", 1)
    unit = F.upper(F.regexp_extract(text, r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*([KMBkmb]?)", 2))
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.when(n != "", F.round(F.try_to_number(F.replace(n, F.lit(","), F.lit("")), F.lit("999999999999.999")).cast("double") * factor).cast("long"))


def _first(html: str, pattern: str) -> Column:
    """The first group of the first match, or null."""
    got = F.regexp_extract(F.col(html), pattern, 1)
    return F.when(got != "", got)


def _links(html: str, path: str) -> Column:
    """Texts of links to paths that hold `path`, in order, each once."""
    found = F.regexp_extract_all(F.col(html), F.lit(rf'(?s)<a[^>]*href="[^"]*{path}[^"]*"[^>]*>(.*?)</a>'), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, text_of), lambda x: x != ""))


def page_titles(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, title, links) of any page: its heading, else its title tag, and the distinct link targets in order."""
    title = F.coalesce(_first(html, r"(?s)<h1[^>]*>(.*?)</h1>"), _first(html, r"(?s)<title[^>]*>(.*?)</title>"))
    links = F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(r'<a[^>]*href="([^"]*)"'), F.lit(1)))
    return unblocked(pages, html).select("page_id", text_of(title).alias("title"), links.alias("links"))


def extract_film_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """(slug, title, year, runtime, is_short, is_animation, avg_rating, rating_count, fan_count, and a list for each attribute).

    The mean rating is a meta tag's, else the page's JSON object's, else the first number that is named so anywhere."""
    known = F.regexp_extract(F.col(html), r'(?s)<script[^>]*application/ld\+json[^>]*>.*?(\{.*?)(?:/\*.*?)?</script>', 1)
    from_json = lambda c: F.get_json_object(known, f"$.aggregateRating.{c}")
    og = _first(html, r'<meta[^>]*property="og:title"[^>]*content="([^"]*)"')
    title = F.coalesce(text_of(_first(html, r'(?s)<h1[^>]*headline-1[^>]*>(.*?)</h1>')), F.trim(F.regexp_replace(og, r"\s*\([0-9]{4}\)\s*$", "")))
    year = F.coalesce(_first(html, r'(?s)<small[^>]*number[^>]*>.*?([0-9]{4})'), F.regexp_extract(og, r"\(([0-9]{4})\)", 1), _first(html, r'"releaseYear"\s*:\s*"?([0-9]{4})'))
    rating = F.coalesce(
        _first(html, r'name="twitter:data2"[^>]*content="([0-9.]+)').try_cast("double"), from_json("ratingValue").try_cast("double"),
        _first(html, r'"ratingValue"\s*:\s*"?([0-9.]+)').try_cast("double"),
    )
    shown = number_of(text_of(_first(html, r'(?s)<a[^>]*href="[^"]*/ratings/"[^>]*>(.*?)</a>')))
    count = F.coalesce(shown, number_of(from_json("ratingCount")), number_of(_first(html, r'"ratingCount"\s*:\s*"?([0-9,]+)')))
    fans = number_of(F.translate(_first(html, r"(?i)([0-9][0-9,.\u202fKMB]*)\s+fans"), "\u202f", ""))
    lists = {k: _links(html, path) for k, path in LINKS.items()}
    lists["genre"] = F.array_distinct(F.transform(lists["genre"], F.lower))
    lists["actor"] = F.slice(lists["actor"], 1, MAX_CAST)
    df = unblocked(pages, html).select(
        "slug", title.alias("title"), year.alias("year_text"), _first(html, r"([0-9]+)\s*mins?").alias("run_text"),
        rating.alias("avg_rating"), count.alias("rating_count"), fans.alias("fan_count"), *[c.alias(k) for k, c in lists.items()],
    )
    df = df.withColumn("year", F.col("year_text").try_cast("int")).withColumn("runtime", F.col("run_text").try_cast("int")).drop("year_text", "run_text")
    short = F.coalesce(F.col("runtime") <= SHORT_MINUTES, F.lit(False)) | F.array_contains("genre", "short")
    return df.withColumn("is_short", short).withColumn("is_animation", F.array_contains("genre", "animation"))


def extract_user_grid_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """(username, slug, rating, watched, watchlisted, liked) from grids of films; pages: username, kind (films or watchlist)."""
    items = F.regexp_extract_all(F.col(html), F.lit(r'(?s)<li[^>]*poster-container.*?</li>'), F.lit(0))
    rows = unblocked(pages, html).select("username", "kind", F.explode(items).alias("item"))
    half = F.regexp_extract("item", r"rated-([0-9]+)", 1).try_cast("int")
    rating = F.when(half.between(1, 10), half / 2.0)
    rows = rows.select("username", F.regexp_extract("item", r'data-film-slug="([a-z0-9:-]+)"', 1).alias("slug"), rating.alias("rating"),
                       (F.col("kind") == "films").alias("watched"), (F.col("kind") == "watchlist").alias("watchlisted"), F.col("item").rlike("icon-liked|like-link").alias("liked")).filter("slug <> ''")
    return rows.groupBy("username", "slug").agg(F.max("rating").alias("rating"), *[F.max(c).alias(c) for c in ("watched", "watchlisted", "liked")])


def extract_list_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """(username, list_slug, is_ranked, is_favorites, position, film_slug); pages: username, list_slug, list_name, page.

    A film's own number counts, else its place over all pages of the list."""
    items = F.regexp_extract_all(F.col(html), F.lit(r'(?s)<li[^>]*poster-container.*?</li>'), F.lit(0))
    rows = unblocked(pages, html).withColumn("items", items)
    w = Window.partitionBy("username", "list_slug").orderBy("page")
    before = F.coalesce(F.sum(F.size("items")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = F.max(F.array_size(F.filter("items", lambda x: x.rlike("list-number"))) > 0).over(Window.partitionBy("username", "list_slug"))
    rows = rows.withColumn("before", before).withColumn("is_ranked", ranked)
    out = rows.select("username", "list_slug", "list_name", "is_ranked", "before", F.posexplode("items").alias("p", "item"))
    said = F.regexp_extract("item", r"list-number[^>]*>\s*([0-9]+)", 1).try_cast("int")
    return out.select("username", "list_slug", "is_ranked", F.lower("list_name").contains("favorite").alias("is_favorites"),
                      F.coalesce(said, (F.col("before") + F.col("p") + 1).cast("int")).alias("position"), F.regexp_extract("item", r'data-film-slug="([a-z0-9:-]+)"', 1).alias("film_slug"))


def extract_member_pages(pages: DataFrame, limit: int = 100, html: str = "html") -> DataFrame:
    """(page_id, rank, username): distinct members in the order in which the page shows them."""
    names = F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(r'<a[^>]*class="[^"]*name[^"]*"[^>]*href="/([a-z0-9_-]+)/"'), F.lit(1)))
    return unblocked(pages, html).select("page_id", F.posexplode(names).alias("p", "username")).filter(F.col("p") < limit).select("page_id", (F.col("p") + 1).alias("rank"), "username")


def extract_favorite_pages(pages: DataFrame, most: int = 4, html: str = "html") -> DataFrame:
    """The films that a member's own page shows as favourites, the first four, as rows of lists: (username, list_slug,
    is_ranked, is_favorites, position, film_slug). An item without a valid film still takes one of the four places."""
    shown = _first(html, r'(?s)<section[^>]*(?:class="[^"]*profile-favorites|id="favourites)[^>]*>(.*?)</section>')
    items = F.slice(F.regexp_extract_all(shown, F.lit(r"(?s)<li[^>]*poster-container.*?</li>"), F.lit(0)), 1, most)
    slugs = F.filter(F.transform(items, lambda x: F.regexp_extract(x, r'data-film-slug="([a-z0-9-]{1,200})"', 1)), lambda x: x != "")
    out = unblocked(pages, html).select("username", F.posexplode(slugs).alias("p", "film_slug"))
    return out.select("username", F.lit("profile-favorites").alias("list_slug"), F.lit(False).alias("is_ranked"), F.lit(True).alias("is_favorites"), (F.col("p") + 1).alias("position"), "film_slug")


def extract_reviewer_pages(pages: DataFrame, limit: int = 50, html: str = "html") -> DataFrame:
    """(slug, rank, username, has_rating, review_date): a film's first reviewers over its pages; pages: slug, page, html.

    The date is the page's text, null where none is shown; a reviewer may come twice."""
    items = F.regexp_extract_all(F.col(html), F.lit(r"(?s)<li[^>]*film-detail.*?</li>"), F.lit(0))
    rows = unblocked(pages, html).select("slug", "page", F.posexplode(items).alias("p", "item"))
    who = F.regexp_extract("item", r'<a[^>]*class="[^"]*\bcontext\b[^"]*"[^>]*href="/([^"/]+)/"', 1)
    date = F.regexp_extract("item", r'(?s)<span[^>]*class="[^"]*_nobr[^"]*"[^>]*>\s*<a[^>]*>(.*?)</a>', 1)
    rated = F.col("item").rlike(r'<span[^>]*class="(?:[^"]* )?rating[ "]')
    rows = rows.select("slug", "page", "p", who.alias("username"), rated.alias("has_rating"), F.when(date != "", text_of(date)).alias("review_date")).filter("username <> ''")
    rank = F.row_number().over(Window.partitionBy("slug").orderBy("page", "p"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= limit).select("slug", "rank", "username", "has_rating", "review_date")


def extract_activity_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """(username, film_count, has_ratings, recent_activity) from a member's own page; no count shown is 0."""
    count = _first(html, r'(?s)<a[^>]*class="[^"]*thousands[^"]*"[^>]*href="[^"]*/films/"[^>]*>\s*<span[^>]*>([0-9,]+)</span>')
    recent = F.coalesce(F.contains(F.col(html), F.concat(F.lit('href="/'), "username", F.lit("/film/"))), F.lit(False))
    return unblocked(pages, html).select(
        "username", F.coalesce(F.replace(count, F.lit(","), F.lit("")).try_cast("int"), F.lit(0)).alias("film_count"),
        F.coalesce(F.col(html).contains("/films/ratings/rated/"), F.lit(False)).alias("has_ratings"), recent.alias("recent_activity"),
    )
