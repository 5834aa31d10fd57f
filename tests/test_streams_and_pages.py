"""Streams equal their batches; pages of the known shapes yield their values."""

import datetime as dt

from pyspark.sql import functions as F

from palate.operators.catalogue import upsert_latest
from palate.sources import pages as X
from palate.streaming import jobs

EVENTS = "user_id long, ts timestamp"


def stream(spark, df, path, files=3):
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_upserts_in_batches_equal_one(spark, tmp_path):
    rows = [(f"u{i % 5}", f"f{i % 7}", i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(60)]
    df = spark.createDataFrame(rows, "username string, slug string, v int, scraped_at timestamp_ntz")
    ordered = [df.filter(f"v between {a} and {a + 19}") for a in (0, 20, 40)]
    for i, part in enumerate(ordered):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.stream_interactions(source, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = upsert_latest(df.limit(0), df, ["username", "slug"], ["scraped_at"])
    assert sorted(tuple(r) for r in got.select(*df.columns).collect()) == sorted(tuple(r) for r in want.collect())


def test_queue_counts_and_sessions_equal_their_batches(spark, tmp_path):
    rows = [(f"e{i % 11}", "film", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i)) for i in range(80)]
    df = spark.createDataFrame(rows, "username string, source_type string, discovered_at timestamp")
    known = spark.createDataFrame([("e3",)], "username string")
    got = jobs.run_to_memory(jobs.stream_queue(stream(spark, df, str(tmp_path / "q")), known), "queue_out", "append", str(tmp_path / "qc"))
    assert sorted(r["username"] for r in got.collect()) == sorted({r[0] for r in rows} - {"e3"})
    attrs = spark.createDataFrame([(f"f{i}", "genre", "ab"[i % 2]) for i in range(9)], "slug string, attr_type string, attr_value string")
    got = jobs.run_to_memory(jobs.stream_idf(stream(spark, attrs, str(tmp_path / "a"))), "idf_out", "complete", str(tmp_path / "ac"))
    assert sorted((r["attr_value"], r["doc_count"]) for r in got.collect()) == [("a", 5), ("b", 4)]
    events = spark.createDataFrame([(i % 3, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i * i)) for i in range(40)], EVENTS)
    got = jobs.run_to_memory(jobs.stream_sessions(stream(spark, events, str(tmp_path / "s")), delay="40 days"), "sessions_out", "complete", str(tmp_path / "sc"))
    batch = jobs.stream_sessions(events)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in batch.collect())


def test_film_pages(spark):
    html = """<h1 class="big headline-1">Salt &lt;&amp;&gt; Iron</h1><small class="number">in <b>1974</b></small>
    <ul><li><a href="/actor/q-one/">Q One</a></li><li><a href="/actor/q-two/">Q Two</a></li></ul>
    <a href="/films/genre/noir/">Noir</a><a href="/films/genre/noir/">NOIR</a><a href="/films/genre/war/">War</a>
    <a href="/director/r-rao/">R Rao</a><a href="/director/s-sun/">S Sun</a>
    <div>Length: 39 mins</div><meta name="twitter:data2" content="2.25 of 5"><a href="/film/salt/ratings/">7,051</a>"""
    other = '<meta property="og:title" content="Second Tide (1931)"><script>{"aggregateRating":{"ratingValue":1.75,"ratingCount":48}}</script>'
    df = spark.createDataFrame([("p", html), ("q", other), ("r", "Solve this CAPTCHA first"), ("s", None)], "slug string, html string")
    got = {r["slug"]: r for r in X.extract_film_pages(df).collect()}
    assert set(got) == {"p", "q", "s"} and got["s"]["title"] is None
    p, q = got["p"], got["q"]
    assert (p["title"], p["year"], p["director"], p["genre"], p["actor"]) == ("Salt <&> Iron", 1974, ["R Rao", "S Sun"], ["noir", "war"], ["Q One", "Q Two"])
    assert (p["runtime"], p["is_short"], p["avg_rating"], p["rating_count"]) == (39, True, 2.25, 7051)
    assert (q["title"], q["year"], q["avg_rating"], q["rating_count"]) == ("Second Tide", 1931, 1.75, 48)


def test_counts_grids_and_lists(spark):
    df = spark.createDataFrame([(t,) for t in ("2.25M", "90,210", "none", "7K likes", "3B")], "t string")
    assert [r[0] for r in df.select(X.number_of(F.col("t"))).collect()] == [2_250_000, 90_210, None, 7_000, 3_000_000_000]
    item = '<li class="poster-container"><div data-film-slug="%s"></div>%s</li>'
    films = item % ("a", '<span class="rated-8"></span>') + item % ("b", '<span class="rated-12 icon-liked"></span>')
    grid = spark.createDataFrame([("u", "films", films), ("u", "watchlist", item % ("a", ""))], "username string, kind string, html string")
    got = {r["slug"]: (r["rating"], r["watched"], r["watchlisted"], r["liked"]) for r in X.extract_user_grid_pages(grid).collect()}
    assert got == {"a": (4.0, True, True, False), "b": (None, True, False, True)}
    pages = spark.createDataFrame([("u", "l", "My Favorites", 1, item % ("a", '<p class="list-number">1.</p>')), ("u", "l", "My Favorites", 2, item % ("b", ""))], "username string, list_slug string, list_name string, page int, html string")
    got = sorted((r["film_slug"], r["position"], r["is_ranked"], r["is_favorites"]) for r in X.extract_list_pages(pages).collect())
    assert got == [("a", 1, True, True), ("b", 2, True, True)]


def test_members_pages_and_reviews(spark):
    item = '<li class="poster-container"><div class="react-component" data-film-slug="%s"></div></li>'
    own = '<section id="favourites">' + "".join(item % x for x in ("one", "BAD!", "two", "three", "four")) + "</section>" + item % "later"
    own += '<a class="stat thousands" href="/ann/films/"><span>12,034</span><span>Films</span></a><a href="/ann/films/ratings/rated/2/">2</a><a href="/bob/film/one/">x</a>'
    df = spark.createDataFrame([("ann", own), ("bob", "<p>nothing</p>"), ("cat", None), ("dan", "Please wait")], "username string, html string")
    got = sorted((r["username"], r["position"], r["film_slug"]) for r in X.extract_favorite_pages(df).collect())
    assert got == [("ann", 1, "one"), ("ann", 2, "two"), ("ann", 3, "three")]
    got = sorted(tuple(r) for r in X.extract_activity_pages(df).collect())
    assert got == [("ann", 12034, True, False), ("bob", 0, False, False), ("cat", 0, False, False)]
    review = '<li class="x film-detail"><a class="context" href="%s">n</a>%s</li>'
    first = review % ("/eve/", '<span class="rating rated-7"></span><span class="date _nobr"><a href="#">3 <b>May</b></a></span>') + review % ("//elsewhere", "") + review % ("/fay/", '<span class="no-rating"></span>')
    df = spark.createDataFrame([("f", 2, review % ("/gus/", "")), ("f", 1, first), ("g", 1, None)], "slug string, page int, html string")
    got = sorted(tuple(r) for r in X.extract_reviewer_pages(df, 3).collect())
    assert got == [("f", 1, "eve", True, "3 May"), ("f", 2, "fay", False, None), ("f", 3, "gus", False, None)]
    assert X.extract_reviewer_pages(df, 1).count() == 1


def test_ratings_of_film_pages_have_three_sources(spark):
    ld = '<script type="application/ld+json">/* x */ {"name": "n", "aggregateRating": {"ratingValue": 3.25, "ratingCount": 812}} /* y */</script>'
    rows = [("a", '<meta name="twitter:data2" content="4.5 out of 5">' + ld), ("b", ld + "<a>26K fans</a>"), ("c", '{"ratingValue": 2.5, "ratingCount": "1,024"} 9,876 Fans'), ("d", "no fans")]
    got = {r["slug"]: (r["avg_rating"], r["rating_count"], r["fan_count"]) for r in X.extract_film_pages(spark.createDataFrame(rows, "slug string, html string")).collect()}
    assert got == {"a": (4.5, 812, None), "b": (3.25, 812, 26000), "c": (2.5, 1024, 9876), "d": (None, None, None)}
