"""How many rows the largest step of a plan makes, and that results stay those of a plain computation."""

import random

import pytest
from pyspark.sql import functions as F

from palate.operators import neighbours as N
from palate.operators import scoring as S


def most_rows(spark, make):
    """(rows, the most rows that one step of the last plan made)."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = make()
        rows = df.collect()
        most, open_ = 0, [df._jdf.queryExecution().executedPlan()]
        while open_:
            node = open_.pop()
            open_ += [node.children().apply(i) for i in range(node.children().size())]
            if node.metrics().contains("numOutputRows"):
                most = max(most, node.metrics().apply("numOutputRows").value())
        return rows, most
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


@pytest.fixture(scope="module")
def ratings(spark):
    rnd = random.Random(9)
    rows = [(f"u{u}", f"f{f}", rnd.randrange(1, 11) / 2) for u in range(120) for f in rnd.sample(range(60), 8)]
    return spark.createDataFrame(rows, "username string, slug string, rating double").cache()


def test_entries_are_not_copied_for_each_block(spark, ratings):
    few, most = most_rows(spark, lambda: N.item_similarity(ratings, at_once=1))
    many, _ = most_rows(spark, lambda: N.item_similarity(ratings))
    assert sorted(map(tuple, few)) == sorted(map(tuple, many)) and len(many) > 50
    assert most <= 5 * ratings.count()  # 60 blocks were 60 times the entries


def test_films_of_equal_tokens_meet_once(spark):
    rows = [(f"f{i:03d}", "genre", v, p) for i in range(240) for p, v in enumerate(("abc"[i % 3], "xyz"[i % 2]), 1)]
    vectors = N.tfidf_vectors(spark.createDataFrame(rows, "slug string, attr_type string, attr_value string, pos int"))
    got, most = most_rows(spark, lambda: N.tfidf_rank(vectors, 4))
    token = {i: {"abc"[i % 3], "xyz"[i % 2]} for i in range(240)}
    for r in got:
        i, j = int(r["slug"][1:]), int(r["other"][1:])
        alike = [k for k in range(240) if k != i and token[k] == token[i]]
        assert j == alike[r["rank"] - 1] and r["score"] == 1.0
    assert len(got) == 960 and most <= 240 * 5


def test_a_director_s_films_do_not_meet_all_who_like_the_director(spark):
    films = [(f"f{i:03d}", (i * 37 % 41) / 10 if i % 9 else None, i * 531 % 30_000) for i in range(300)]
    attrs = [(s, "director", f"d{int(s[1:]) % 3}", 1) for s, _, _ in films]
    profile = [(f"u{u}", "director", f"d{d}", 2.0 + d, 1) for u in range(40) for d in range(u % 4)]
    rnd = random.Random(2)
    best = sorted(films, key=lambda f: (-((f[1] or 0) + min(f[2] / 10_000, 2.0)), f[0]))
    seen = {(f"u{u}", s) for u in range(40) for s, _, _ in rnd.sample(best[:40], u % 30)}
    frames = (
        spark.createDataFrame(profile, "username string, attr_type string, attr_value string, score double, n int"), spark.createDataFrame(sorted(seen), "username string, slug string"),
        spark.createDataFrame(attrs, "slug string, attr_type string, attr_value string, pos int"), spark.createDataFrame(films, "slug string, avg_rating double, rating_count int"),
    )
    got, most = most_rows(spark, lambda: S.director_gaps(*frames))
    want = {}
    for u, _, d, _, _ in profile:
        free = [s for s, _, _ in best if f"d{int(s[1:]) % 3}" == d and (u, s) not in seen]
        want.update({(u, d, i): s for i, s in enumerate(free[:3], 1)})
    assert {(r["username"], r["director"], r["rank"]): r["slug"] for r in got} == want
    assert most <= len(seen) + 3 * len(profile)  # each user met 100 films of each director before


def test_single_kinds_need_no_profile_of_all_attributes(spark, monkeypatch):
    from palate.plans import scores
    from palate.plans.registry import QUERIES

    def whole(*_):
        raise AssertionError("the whole profile was asked for")

    monkeypatch.setattr(scores, "profile_of", whole)
    for name, least in (("decade_rule", 1), ("genre_pair_rule", 0), ("momentum_rule", 0)):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= least


def test_recommended_films_are_explained_without_all_others(spark, ratings):
    from palate.operators import reasons as R

    sim = N.item_similarity(ratings).cache()
    anchors = ratings.filter("rating >= 3.5").select("username", "slug")
    found, most = most_rows(spark, lambda: N.item_recommend(sim, anchors, ratings, 3))
    pairs = {}
    seen = {(r["username"], r["slug"]) for r in ratings.collect()}
    alike = {}
    for r in sim.collect():
        alike.setdefault(r["slug"], []).append((r["other"], r["sim"]))
    mine = {(r["username"], r["slug"]) for r in anchors.collect()}
    for u, s in mine:
        for o, x in alike.get(s, ()):
            if (u, o) not in seen:
                pairs.setdefault(u, {}).setdefault(o, []).append((-x, s))
    want = {u: sorted((-round(sum(-x for x, _ in v), 9), o) for o, v in films.items())[:3] for u, films in pairs.items()}
    assert {(r["username"], r["rank"]): r["slug"] for r in found} == {(u, i): o for u, best in want.items() for i, (_, o) in enumerate(best, 1)}
    asked = spark.createDataFrame([(r["username"], r["slug"]) for r in found[:40]], "username string, slug string")
    said, most = most_rows(spark, lambda: R.similar_to(anchors, sim, asked))
    assert {(r["username"], r["slug"]): r["reasons"] for r in said} == {(r["username"], r["slug"]): [f"Similar to {s}" for _, s in sorted(pairs[r["username"]][r["slug"]])[:3]] for r in found[:40]}
    assert most < sum(len(v) for films in pairs.values() for v in films.values()) / 2  # all pairs were made before
