"""Exact values of the taste model on hand-made tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from palate.functions import weights as W
from palate.operators import catalogue as C
from palate.operators import graph as G
from palate.operators import groups as J
from palate.operators import neighbours as N
from palate.operators import profile as P
from palate.operators import queue as Q
from palate.operators import reasons as R
from palate.operators import scoring as S

INTER = "username string, slug string, rating double, watched boolean, watchlisted boolean, liked boolean, scraped_at timestamp_ntz"
ATTRS = "slug string, attr_type string, attr_value string, pos int"
FILMS = "slug string, title string, year int, avg_rating double, rating_count long"
LISTS = "username string, list_slug string, is_favorites boolean, is_ranked boolean, position int, film_slug string"
AT = dt.datetime(2001, 1, 1)


def asof():
    return F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")


def seen(user, slug, rating=None, watched=True, watchlisted=False, liked=False, at=AT):
    return (user, slug, rating, watched, watchlisted, liked, at)


def attr(slug, **kinds):
    return [(slug, k, v, i + 1) for k, values in kinds.items() for i, v in enumerate(values if isinstance(values, list) else [values])]


def test_interaction_weights(spark):
    rows = [seen("u", str(i), r, w, wl, li) for i, (r, w, wl, li) in enumerate([
        (4.5, True, False, False), (3.5, True, False, True), (3.0, True, False, False), (2.0, True, False, False), (0.5, True, False, False),
        (None, True, False, True), (None, True, False, False), (None, False, True, False), (None, False, False, False)])]
    got = spark.createDataFrame(rows, INTER).select("slug", W.interaction_weight().alias("w")).orderBy("slug").collect()
    assert [r["w"] for r in got] == [2.0, 1.0, 0.3, -0.5, -1.5, 1.5, 0.4, 0.2, 0.0]


def test_decay_halves_and_has_a_floor(spark):
    days = [0, 730, 1460, 100_000, -5]
    df = spark.createDataFrame([(AT - dt.timedelta(days=d),) for d in days] + [(None,)], "t timestamp_ntz")
    assert [round(r[0], 6) for r in df.select(W.temporal_weight(F.col("t"), asof())).collect()] == [1.0, 0.5, 0.25, 0.1, 1.0, 1.0]


def test_list_multiplier_takes_the_best(spark):
    rows = [("u", "a", True, False, None, "f1"), ("u", "b", False, True, 10, "f2"), ("u", "b", False, True, 30, "f3"), ("u", "b", False, True, 31, "f4"), ("u", "c", False, False, None, "f5"), ("u", "c", False, False, None, "f1")]
    got = {r["slug"]: r["multiplier"] for r in P.list_multiplier(spark.createDataFrame(rows, LISTS)).collect()}
    assert got == {"f1": 3.0, "f2": 2.0, "f3": 1.5, "f4": 1.2, "f5": 1.3}


def test_momentum_with_two_ratings_a_side_is_zero(spark):
    old = AT - dt.timedelta(days=900)
    inter = spark.createDataFrame([seen("u", "a", 2.0, at=old), seen("u", "b", 2.5, at=old), seen("u", "c", 5.0), seen("u", "d", 4.5)], INTER)
    attrs = spark.createDataFrame([x for s in "abcd" for x in attr(s, genre="horror")], ATTRS)
    assert [r["momentum"] for r in P.preference_momentum(inter, attrs, asof()).collect()] == [0.0]


def test_genre_interaction_of_a_disliked_pair_is_negative(spark):
    inter = spark.createDataFrame([seen("u", s, r) for s, r in zip("abcde", (2.0, 2.5, 1.5, 4.0, 4.0))], INTER)
    attrs = spark.createDataFrame([x for s in "abc" for x in attr(s, genre=["horror", "comedy"])] + attr("d", genre="horror") + attr("e", genre="comedy"), ATTRS)
    got = P.genre_interactions(inter, attrs).collect()
    assert [(r["a"], r["b"], r["n"]) for r in got] == [("comedy", "horror", 3)] and got[0]["effect"] < 0


def test_negative_scores_are_penalised_before_cap_and_weight(spark):
    profile = spark.createDataFrame([("u", "genre", "g", -1.0, 5), ("u", "director", "d", -1.0, 3)], "username string, attr_type string, attr_value string, score double, n long")
    idf = spark.createDataFrame([], "attr_type string, attr_value string, doc_count long, idf double")
    films = S.film_vectors(spark.createDataFrame(attr("f", genre="g", director="d"), ATTRS))
    pairs = spark.createDataFrame([("u", "f")], "username string, slug string")
    got = S.attribute_scores(pairs, S.user_vectors(profile, idf), films).agg(F.sum("score")).first()[0]
    assert got == pytest.approx(-(2.0 * 3.0) - 1.5)


def test_block_scores_equal_pair_scores(spark):
    import random

    rng = random.Random(1)
    users, films = [f"u{i}" for i in range(8)], [f"f{i}" for i in range(40)]
    attrs = spark.createDataFrame([x for f in films for x in attr(f, genre=rng.sample("abcd", 2), director=rng.choice("xyz"), actor=rng.sample("klmnop", 3), country=rng.sample("AB", 2))], ATTRS)
    catalogue = spark.createDataFrame([(f, f, 1950 + i, float(rng.randint(1, 5)), rng.randint(0, 20_000)) for i, f in enumerate(films)], FILMS)
    inter = spark.createDataFrame([seen(u, f, rng.choice([None, 1.0, 2.0, 4.0, 5.0]), liked=rng.random() < 0.3) for u in users for f in rng.sample(films, 12)], INTER)
    weights = P.weighted(inter, spark.createDataFrame([], LISTS), asof())
    decades = P.with_decades(attrs, catalogue)
    stats, negatives = P.profile_stats(weights, catalogue), S.negative_profile(inter, attrs)
    vectors = S.user_vectors(P.profile_attrs(weights, decades), C.attribute_idf(attrs, catalogue), P.genre_pairs(weights, attrs), P.genre_interactions(inter, attrs), P.preference_momentum(inter, attrs, asof()))
    fv = S.film_vectors(decades)
    got = S.recommend_metadata(inter, vectors, fv, catalogue, stats, negatives, 5, users_at_once=3, films_at_once=7).collect()
    pairs = C.unseen_candidates(stats.select("username").crossJoin(catalogue.select("slug")), inter)
    scored = S.score_pairs(pairs, vectors, fv, catalogue, stats).filter("score > 0").join(S.negative_penalty(pairs, negatives, attrs), ["username", "slug"], "left")
    scored = scored.withColumn("score", F.round(F.col("score") - F.coalesce("penalty", F.lit(0.0)), 9)).filter("score > 0")
    want = S.top_n(scored, 5).collect()
    key = lambda rows: sorted((r["username"], r["rank"], r["slug"], round(r["score"], 6)) for r in rows)
    assert key(got) == key(want) and got


def test_group_strategies(spark):
    def by(strategy, scores):
        df = spark.createDataFrame([("g", "f", float(s)) for s in scores], "group_id string, slug string, score double")
        return J.aggregate_scores(df, strategy).first()["group_score"]

    assert [by(k, [1, 7, 4]) for k in ("least_misery", "most_pleasure", "average", "fairness")] == [1, 7, 4, pytest.approx(4 - 1.5**0.5)]
    assert by("multiplicative", [1, 8, 27]) == pytest.approx(6) and by("multiplicative", [5, 3, 0]) == 0
    assert by("approval", [6, 0.5, 3, 1]) == pytest.approx(2.2625)


def test_group_weights_parse_leniently(spark):
    df = spark.createDataFrame([(t,) for t in ("Kim_7:0.75", "lena", "omar:heavy", "pia:3", ":2")], "t string")
    user, weight = J.parse_weight(F.col("t"))
    assert [tuple(r) for r in df.select(user, weight).collect()] == [("kim_7", 0.75), (None, None), (None, None), ("pia", 3.0), ("", 2.0)]


def test_compatibility(spark):
    cols = "username string, attr_type string, attr_value string, score double, n long"
    rows = [("a", "genre", "x", 1.0, 1), ("a", "genre", "y", 1.0, 1), ("b", "genre", "x", 1.0, 1), ("b", "genre", "y", -1.0, 1)]
    rows += [("a", "director", "p", 1.0, 1), ("a", "director", "q", 1.0, 1), ("b", "director", "p", 1.0, 1), ("b", "director", "q", -1.0, 1), ("a", "decade", "1990", 2.0, 1), ("b", "decade", "1990", 1.0, 1)]
    members = spark.createDataFrame([("g", "a", 1.0, 2), ("g", "b", 1.0, 2)], "group_id string, username string, weight double, n_members long")
    assert J.pairwise_compatibility(members, spark.createDataFrame(rows, cols)).first()["compatibility"] == pytest.approx(2 / 3)
    assert J.pairwise_compatibility(members, spark.createDataFrame([], cols)).first()["compatibility"] == 0.5


def test_upserts_and_normalised_attributes(spark):
    base = spark.createDataFrame([("u", "a", 1, 5), ("u", "b", 2, 5)], "username string, slug string, v int, t int")
    delta = spark.createDataFrame([("u", "a", 7, 1), ("u", "a", 9, 2), ("w", "c", 3, 1)], base.schema)
    got = sorted(tuple(r) for r in C.upsert_latest(base, delta, ["username", "slug"], ["t"]).collect())
    assert got == [("u", "a", 9, 2), ("u", "b", 2, 5), ("w", "c", 3, 1)]
    films = spark.createDataFrame([("f", ["x", "y", "x"], None), ("g", [], ["d"])], "slug string, genres array<string>, directors array<string>")
    long = C.normalize_attrs(films, {"genre": "genres", "director": "directors"})
    assert sorted(tuple(r) for r in long.collect()) == [("f", "genre", "x", 1), ("f", "genre", "y", 2), ("g", "director", "d", 1)]
    fresh = spark.createDataFrame([("f", "genre", "z", 1)], ATTRS)
    assert sorted(r["attr_value"] for r in C.replace_attrs(long, fresh).collect()) == ["d", "z"]


def test_filters_keep_or_drop_nulls(spark):
    films = spark.createDataFrame([("old", "o", 1931, 2.25, 1), ("edge", "e", 1958, 4.75, 1), ("none", "n", None, None, 1), ("new", "w", 1977, 4.0, 1)], FILMS)
    names = lambda df: [r["slug"] for r in df.orderBy("slug").collect()]
    assert names(C.filter_years(films, 1931, 1958)) == ["edge", "old"]
    assert names(C.filter_years(films, 1958, 1976, nulls="keep")) == ["edge", "none"]
    assert names(C.filter_min_rating(films, 4.0)) == ["edge", "new", "none"]


def test_slugs(spark):
    df = spark.createDataFrame([(s,) for s in ("red-river-2", "film:77", " FILM:77 ", "Red River", "x" * 201, "y" * 200)], "s string")
    assert [r[0] for r in df.select(C.clean_slug(F.col("s"))).collect()] == ["red-river-2", "film:77", "film:77", None, None, "y" * 200]


def test_queue_adds_each_name_once(spark):
    found = [("ida", "taste", AT, 5), ("jon", "popular", AT, 9), ("jon", "following", AT, 6), ("lev", "film_reviews", AT, 7), ("lev", "popular", AT, 8)]
    cands = spark.createDataFrame(found, "username string, source_type string, discovered_at timestamp_ntz, event_id long")
    none = cands.limit(0)
    inter = spark.createDataFrame([seen("ida", "f")], INTER)
    added = Q.queue_add(cands, none, inter)
    assert sorted((r["username"], r["priority"]) for r in added.collect()) == [("jon", 80), ("lev", 100)]
    assert Q.queue_add(cands, added, inter).count() == 0


@pytest.mark.parametrize("most_edges", [1000, 0])  # in groups, and by joins
def test_walk_equals_a_matrix(spark, most_edges):
    import numpy as np

    rng = np.random.default_rng(3)
    nodes = ["user:u", "user:w", *(f"film:f{i}" for i in range(8)), *(f"genre:g{i}" for i in range(3)), "x"]
    edges = [(a, b, t, float(rng.integers(1, 9))) for a in nodes[:-1] for b in nodes if a != b and rng.random() < 0.3 for t in ("liked", "genre")]
    edges = spark.createDataFrame(edges, "src string, dst string, edge_type string, weight double")
    inter = spark.createDataFrame([seen("u", "f0", liked=True), seen("u", "f3", 4.0), seen("w", "f1", 2.0), seen("w", "gone")], INTER)
    films = spark.createDataFrame([(f"f{i}", "t", 2000, 3.0, 1) for i in range(8)], FILMS)
    step, restart = G.transition(edges), G.restart_distribution(inter, films)
    got = G.personalized_pagerank(step, restart, iterations=200, tolerance=1e-10, most_edges=most_edges)
    mass = {(r["username"], r["node"]): r["mass"] for r in got.collect()}
    p = np.zeros((len(nodes), len(nodes)))
    for r in step.collect():
        p[nodes.index(r["dst"]), nodes.index(r["src"])] = r["p"]
    every = G.recommend_graph(step, restart, inter, films, 3, iterations=200, tolerance=1e-10, most_edges=most_edges).orderBy("rank").collect()
    for user in "uw":
        start = np.zeros(len(nodes))
        for r in restart.filter(F.col("username") == user).collect():
            start[nodes.index(r["node"])] = r["mass"]
        now = start
        for _ in range(400):
            now = 0.15 * start + 0.85 * (p @ now + now[p.sum(0) == 0].sum() * start)
        assert sum(now) == pytest.approx(1.0)
        assert all(mass.get((user, n), 0.0) == pytest.approx(now[i], abs=1e-8) for i, n in enumerate(nodes))
        seen_films = {r["slug"] for r in inter.collect() if r["username"] == user}
        best = sorted((-now[nodes.index(f"film:f{i}")], f"f{i}") for i in range(8) if f"f{i}" not in seen_films and now[nodes.index(f"film:f{i}")] > 0)[:3]
        recs = [r for r in every if r["username"] == user]
        assert [(r["slug"], pytest.approx(r["score"], abs=1e-8)) for r in recs] == [(s, -m) for m, s in best]


def test_paths_equal_a_breadth_first_search(spark):
    rng = random.Random(4)
    nodes = [*(f"film:{i}" for i in range(7)), *(f"genre:{i}" for i in range(3)), "user:a"]
    links = {(a, b): rng.choice(["genre", "liked"]) for a in nodes for b in nodes if a != b and rng.random() < 0.2}
    edges = spark.createDataFrame([(a, b, t, 1.0) for (a, b), t in links.items()], "src string, dst string, edge_type string, weight double")
    pairs = [(u, str(i), str(j)) for u in "xy" for i in range(3) for j in range(3, 7) if rng.random() < 0.7] + [("x", "5", "5")]
    got = {(r["username"], r["slug"]): list(r["paths"]) for r in G.explain_paths(edges, spark.createDataFrame(pairs, "username string, liked string, slug string"), 4, 3).collect()}
    want = {}
    for u, i, j in pairs:
        front = [[f"film:{i}"]] if i != j else []
        for length in range(1, 5):
            front = [[*p, b] for p in front for b in nodes if (p[-1], b) in links and b not in p and p[-1] != f"film:{j}"]
            for p in front:
                if p[-1] == f"film:{j}":
                    text = p[0] + "".join(f" -({links[a, b]})-> {b}" for a, b in zip(p, p[1:]))
                    want.setdefault((u, j), []).append((length, text))
    assert got == {k: [t for _, t in sorted(v)[:3]] for k, v in want.items()}


def test_surprises_stand_at_every_fifth_place(spark):
    n_films = 120
    ranked = [("u", i + 1, f"f{i:03}", 100.0 - i) for i in range(n_films)] + [("short", i + 1, f"f{i:03}", 9.0 - i) for i in range(4)]
    films = spark.createDataFrame([(f"f{i:03}", "t", 1990, 4.0 if i % 2 else 3.0, 10) for i in range(n_films)], FILMS)
    attrs = spark.createDataFrame([x for i in range(n_films) for x in attr(f"f{i:03}", genre=["known"] if i % 7 else ["new", "other"], country="home")], ATTRS)
    profile = spark.createDataFrame([("u", "genre", "known", 1.0, 40), ("u", "country", "home", 1.0, 40), ("u", "decade", "1990", 1.0, 40)], "username string, attr_type string, attr_value string, score double, n long")
    df = spark.createDataFrame(ranked, "username string, rank int, slug string, score double")
    out = R.inject_serendipity(df, profile, attrs, films, 20).orderBy("username", "rank").collect()
    mine = [(r["slug"], r["discovery"]) for r in out if r["username"] == "u"]
    picks = [f"f{i:03}" for i in range(50, 96) if i % 2 and i % 7 == 0][:3]  # well rated, with two new genres, from the middle ranks
    core = [f"f{i:03}" for i in range(17)]
    want = list(core)
    for i, p in enumerate(picks):
        want.insert(min((i + 1) * 5, len(want)), p)
    assert [s for s, _ in mine] == want and [s for s, d in mine if d] == picks
    assert [r["slug"] for r in out if r["username"] == "short"] == [f"f{i:03}" for i in range(4)]


def test_svd_ranking_equals_a_dense_decomposition(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(f"u{i}", f"f{j}", float(rng.integers(1, 6))) for i in range(9) for j in range(12) if rng.random() < 0.6]
    matrix = spark.createDataFrame(rows, "username string, slug string, value double")
    users, items, bias = *Q.fit_svd(matrix, 3), Q.bias_model(matrix)
    seen_ = spark.createDataFrame([seen(u, f) for u, f, _ in rows], INTER)
    got = {}
    for r in Q.recommend_svd(bias, users, items, seen_, n=4).orderBy("username", "rank").collect():
        got.setdefault(r["username"], []).append((r["slug"], r["score"]))
    mu = np.mean([v for *_, v in rows])
    mean = lambda k, name: np.mean([r[2] for r in rows if r[k] == name]) - mu
    us, fs = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    bu, bi = np.array([mean(0, u) for u in us]), np.array([mean(1, f) for f in fs])
    c = np.zeros((len(us), len(fs)))
    for u, f, v in rows:
        c[us.index(u), fs.index(f)] = v - mu - bu[us.index(u)] - bi[fs.index(f)]
    a, d, b = np.linalg.svd(c)
    score = mu + bu[:, None] + bi[None] + a[:, :3] @ np.diag(d[:3]) @ b[:3]
    known = {(u, f) for u, f, _ in rows}
    for i, u in enumerate(us):
        best = sorted((-score[i, j], f) for j, f in enumerate(fs) if (u, f) not in known)[:4]
        assert [(f, pytest.approx(s, abs=1e-6)) for f, s in got[u]] == [(f, -s) for s, f in best]
    only = spark.createDataFrame([("f1",), ("f2",)], "slug string")
    assert {r["slug"] for r in Q.recommend_svd(bias, users, items, seen_, only, 4).collect()} <= {"f1", "f2"}
    print_ = Q.model_fingerprint(matrix, factors=3)
    assert Q.same_model(print_, print_) and not Q.same_model(print_, Q.model_fingerprint(matrix, factors=4))


def test_budgets_seeds_and_presets(spark):
    edges = spark.createDataFrame([("a", "b", "genre", 1.0), ("a", "c", "genre", 3.0), ("a", "d", "director", 5.0)], "src string, dst string, edge_type string, weight double")
    p = {r["dst"]: r["p"] for r in G.transition(edges, budgets=True).collect()}
    assert p == {"b": pytest.approx(1.5 / 4.5 / 4), "c": pytest.approx(1.5 / 4.5 * 3 / 4), "d": pytest.approx(3.0 / 4.5)}
    assert G.relation_weights("social")["follows"] == 1.2 and G.relation_weights("balanced", '{"genre": 2}') == {"genre": 2.0} and G.relation_weights("x", "{bad") == G.RELATION
    with pytest.raises(ValueError):
        G.relation_weights("balanced", '{"genre": 0}')
    inter = spark.createDataFrame([seen("u", "a", liked=True)], INTER)
    films = spark.createDataFrame([(s, s, 2000, 3.0, 1) for s in "ab"], FILMS)
    seeds = spark.createDataFrame([("u", "b"), ("new", "a"), ("none", "zz")], "username string, slug string")
    got = {(r["username"], r["node"]): r["mass"] for r in G.restart_distribution(inter, films, seeds).collect()}
    assert got[("u", "film:b")] == pytest.approx(0.8 * 0.8 / 1.5) and got[("new", "film:a")] == pytest.approx(0.8) and got[("none", "user:none")] == 1.0


def test_cold_users_get_likeness_and_rules_plug_in(spark):
    inter = spark.createDataFrame([seen("cold", "a"), seen("cold", "b", watched=False, watchlisted=True), seen("warm", "a", 4.0), seen("warm", "b", watched=False, watchlisted=True)], INTER)
    films = spark.createDataFrame([(s, s, 2000, 3.0, 100) for s in "ab"], FILMS)
    attrs = spark.createDataFrame([x for s in "ab" for x in attr(s, genre="drama", director="D")], ATTRS)
    assert [r[0] for r in S.cold_users(inter).collect()] == ["cold"]
    cold = spark.createDataFrame([("cold", "b", 0.5), ("warm", "b", 9.0)], "username string, slug string, score double")
    users = spark.createDataFrame([("warm", "genre", "drama", 1.0)], "username string, kind string, value string, x double")
    stats = spark.createDataFrame([("warm", 4.0)], "username string, weighted_mean double")
    vectors, none = S.film_vectors(attrs), S.negative_profile(inter, attrs)
    got = {r["username"]: r["score"] for r in S.triage_watchlist(inter, users, vectors, films, stats, none, attrs, 5, cold).collect()}
    assert got == {"cold": 0.5, "warm": pytest.approx(1.4)}
    rules = (*S.RULES, lambda rows: F.when(F.col("slug") == "b", 7.0).otherwise(0.0))
    scored = S.score_pairs(inter.filter("watchlisted"), users, vectors, films, stats, rules)
    assert {r["username"]: r["score"] for r in scored.collect()} == {"cold": pytest.approx(7.4), "warm": pytest.approx(8.4)}
    hybrid = N.recommend_hybrid(cold, cold.limit(0), inter, 5, wc=0.25)
    assert {r["username"]: r["score"] for r in hybrid.collect()} == {"cold": 0.0, "warm": 0.0}


def test_diversify_caps_directors(spark):
    ranked = spark.createDataFrame([("u", i + 1, f"f{i}") for i in range(6)], "username string, rank int, slug string")
    attrs = spark.createDataFrame([x for i, d in enumerate("aaabbc") for x in attr(f"f{i}", director=d)], ATTRS)
    assert [r["slug"] for r in S.diversify(ranked, attrs, 4, most=1).orderBy("rank").collect()] == ["f0", "f3", "f5"]


def test_neighbours_favourite_comes_first(spark):
    inter = spark.createDataFrame(
        [seen("alice", "a", 4.5), seen("alice", "c", 2.0), seen("bob", "a", 4.5), seen("bob", "b", 5.0), seen("bob", "c", 2.0), seen("carol", "a", 4.0), seen("carol", "b", 4.5), seen("carol", "c", 1.5)], INTER
    )
    films = spark.createDataFrame([(s, s, 2000, 3.0, 0) for s in "abc"], FILMS)
    got = N.recommend_collaborative(inter, films, 5, min_overlap=2).filter("username = 'alice'").orderBy("rank").collect()
    assert got[0]["slug"] == "b"


def test_svd_recovers_a_low_rank_matrix(spark):
    rows = [("alice", "a", 5.0), ("alice", "b", 1.0), ("bob", "a", 5.0), ("bob", "b", 1.0), ("bob", "c", 5.0), ("carol", "a", 1.0), ("carol", "b", 5.0), ("carol", "c", 1.5)]
    matrix = spark.createDataFrame(rows, "username string, slug string, value double")
    users, items = Q.fit_svd(matrix, 2)
    pairs = spark.createDataFrame([("alice", "c"), ("nobody", "c")], "username string, slug string")
    got = {r["username"]: r["prediction"] for r in Q.predict_svd(pairs, Q.bias_model(matrix), users, items).collect()}
    assert got["nobody"] is None and 0.5 <= got["alice"] <= 5


def test_no_film_or_token_is_dropped_by_number(spark):
    groups = 10_001  # two users rate three films, two of them alike
    rated = spark.range(groups * 6).selectExpr("concat('u', id div 3) as username", "concat('f', id div 6, '-', id % 3) as slug", "if(id % 3 = 2, 1.0D, 5.0D) as rating")
    assert N.item_similarity(rated).select("slug").distinct().count() == 2 * groups
    assert N.item_similarity(rated, max_items=30).select("slug").distinct().count() <= 30
    attrs = spark.range(2 * 20_001).selectExpr("concat('f', id) as slug", "'genre' as attr_type", "concat('g', id div 2) as attr_value")
    assert N.tfidf_vectors(attrs).select("token").distinct().count() == 20_001


def test_diversify_query_walks_the_whole_ranking(spark, monkeypatch):
    from palate.plans import registry, scores  # noqa: F401

    inter = spark.createDataFrame([seen("u", f"f{i:03}", 4.0) for i in range(100)], INTER)
    attrs = spark.createDataFrame([x for i in range(100) for x in attr(f"f{i:03}", director="one" if i < 60 else f"d{i}")], ATTRS)
    monkeypatch.setattr(registry, "Views", lambda *_: type("V", (), {"interactions": inter, "film_attrs": attrs}))
    got = registry.QUERIES["diversify"](spark, "")
    assert [r["slug"] for r in got.orderBy("rank").collect()] == ["f000", "f001", *(f"f{i:03}" for i in range(60, 68))]
