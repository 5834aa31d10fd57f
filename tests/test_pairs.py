"""Partners by an index against all pairs as rows, with a film that all have rated; weights at their steps under any partitioning."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palate.operators import neighbours as N
from palate.operators import pairs
from palate.operators import profile as P

RATED = "username string, slug string, rating double"


@pytest.fixture(scope="module")
def ratings(spark):
    rnd = random.Random(4)
    rows = [(f"u{u}", "hot", rnd.randrange(1, 11) / 2) for u in range(90)]
    rows += [(f"u{u}", f"f{f}", rnd.randrange(1, 11) / 2) for u in range(90) for f in rnd.sample(range(40), rnd.randrange(14))]
    rows += [("same", f"f{f}", 3.0) for f in range(20)] + [("u1", "f99", None)]
    return spark.createDataFrame(rows, RATED).cache()


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("heavy, at_once, overlap", [(1, 16, 5), (30, 1024, 3), (10**6, 40, 5), (1, 1024, 1)])
def test_similar_users_are_those_of_all_pairs(spark, ratings, heavy, at_once, overlap):
    n = F.col("overlap")
    score = F.round(F.col("cosine") * F.least(n / 20.0, F.lit(1.0)) * n / (n + 10.0), 9)
    found = N.rated_pairs(ratings).filter(n >= overlap).withColumn("score", score).filter("score > 0")
    want = N.top_n(found, 4, "username", "other").select("username", "rank", "other", "score")
    got = N.user_neighbors(N.rated_entries(ratings), 4, overlap, at_once, heavy)
    assert rows_of(got) == rows_of(want) and got.count() > 100


@pytest.mark.parametrize("at_once", [16, 1024])
def test_influencers_are_those_of_all_pairs(spark, ratings, at_once):
    counts = ratings.filter("rating is not null").groupBy("username").agg(F.count("*").alias("n"))
    rows = N.rated_pairs(ratings).join(counts, "username").join(counts.select(F.col("username").alias("other"), F.col("n").alias("m")), "other").collect()
    want = {}
    for r in rows:
        ratio = r["m"] / r["n"]
        weight = min(ratio, 2.0) if ratio > 1 else min(1 / max(ratio, 0.1), 2.0)
        want.setdefault((r["username"], "influencer" if ratio > 1 else "follower"), []).append((-round(r["agreement"] * weight * r["overlap"] / 20, 9), r["other"]))
    got = {}
    for r in N.asymmetric_neighbors(N.rated_entries(ratings), 3, at_once).orderBy("rank").collect():
        got.setdefault((r["username"], r["role"]), []).append((-r["score"], r["other"]))
    assert set(got) == set(want)
    for key, best in got.items():
        assert np.allclose([b[0] for b in best], [w[0] for w in sorted(want[key])[:3]], atol=2e-9)


@pytest.mark.parametrize("at_once", [7, 1024])
def test_similar_items_are_those_of_all_pairs(spark, ratings, at_once):
    c = {(r["slug"], r["username"]): r["c"] for r in N.centered_ratings(ratings).collect()}
    slugs = sorted({s for s, _ in c})
    want = set()
    for a in slugs:
        for b in slugs:
            both = [(c[a, u], c[b, u]) for s, u in c if s == a and (b, u) in c]
            x, y = (np.array(v) for v in zip(*both)) if both else (np.zeros(0), np.zeros(0))
            if a != b and len(x) >= 2 and (x @ x) > 0 and (y @ y) > 0 and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) > 0.3:
                want.add((a, b))
    got = N.item_similarity(ratings, k=100, at_once=at_once)
    assert {(r["slug"], r["other"]) for r in got.collect()} == want
    some = ratings.select("slug").distinct().filter("slug in ('hot', 'f3')")
    assert rows_of(N.item_similarity(ratings, k=100, only=some, at_once=at_once)) == rows_of(got.filter("slug in ('hot', 'f3')"))


def test_a_film_that_all_have_rated_is_no_single_task(spark, ratings):
    entries = N.rated_entries(ratings)

    def count(one, other, sums):
        return np.array([0]), np.array([0]), [float(sums[0].sum())]

    def shares(indexed):
        met = pairs.meet(entries, ["u"], lambda x, y: [x["u"]], count, "one string, other string, met double", indexed, at_once=15)
        return [r["met"] for r in met.collect()]

    whole, cut = shares(None), shares((F.col("place") > 4) | (F.col("many") <= 60))
    assert len(whole) >= 36 and max(whole) < 0.1 * sum(whole)  # blocks share the film's pairs
    assert sum(whole) - sum(cut) == 90 * 89  # and out of the index they aren't made at all
    assert entries.filter("many > 60").select("what").distinct().collect()[0][0] == "hot"


def test_weights_at_a_step_don_t_hang_on_the_order_of_sums(spark):
    rows = [(f"u{u}", f"f{k}", r) for u in range(40) for k, r in enumerate([1.5, 2.5] * 6 + [3.0, 1.0] * (u % 3))]
    rows += [(f"v{u}", f"f{k}", r) for u in range(40) for k, r in enumerate([0.5 + 0.1 * u, 1.5 + 0.1 * u, 2.5 + 0.1 * u, 2.5 + 0.1 * u] * 3)]
    df = spark.createDataFrame([(*r, False, False, False) for r in rows], RATED + ", liked boolean, watched boolean, watchlisted boolean")
    for mode in ("normalized", "blended"):
        found = [rows_of(P.with_base_weight(df.repartition(n, F.rand(n)), mode).select("username", "slug", "rating", "base")) for n in (1, 8, 64)]
        assert found[0] == found[1] == found[2]
    exact = P.with_base_weight(df.filter("username = 'u0'"), "normalized").select("rating", "base").distinct().collect()
    assert {(r["rating"], r["base"]) for r in exact} == {(2.5, 1.0), (1.5, -0.5)}  # distances of just 1 and -1


def test_merged_reasons_keep_the_sides_order(spark):
    from palate.operators import reasons as R

    first = spark.createDataFrame([("u", "f", ["b", "a"], ["w"]), ("u", "g", None, ["w"])], "username string, slug string, reasons array<string>, warnings array<string>")
    second = spark.createDataFrame([("u", "f", ["a", "c", "w"]), ("u", "h", ["z", "z"]), ("x", "h", None)], "username string, slug string, reasons array<string>")
    got = {(r["username"], r["slug"]): r["reasons"] for r in R.merge_reasons(first, second).collect()}
    assert got == {("u", "f"): ["b", "a", "w", "c"], ("u", "g"): ["w"], ("u", "h"): ["z"], ("x", "h"): []}
    assert R.merge_reasons(second).count() == 3
