"""Vector operators against all pairs."""

import numpy as np
import pandas as pd

from palate.llm import embeddings
from palate.llm.common import connected_components, forest


def odd_vectors(spark, n=600, dims=16):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, dims))
    x = np.vstack([centres[rng.integers(0, 40, n // 2)] + 0.08 * rng.standard_normal((n // 2, dims)), rng.standard_normal((n // 2, dims))]).astype(np.float32)
    x[5], x[6] = x[4], 3 * x[4]
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    more = [(n, None), (n + 1, [0.0] * dims), (n + 2, [float("nan")] * dims), (n + 3, [None] * dims), (n + 4, []), (n + 50, [float("inf")] + [0.0] * (dims - 1)), (n + 6, [1.0, 2.0]), (None, [1.0] * dims)]
    return x.astype(float), spark.createDataFrame(rows + [(*m, "clash") for m in more] + rows[:1], "vec_id long, embedding array<float>, id string")


def test_links_components_and_counts_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 32)  # hot groups are met by pairs of blocks
    x, df = odd_vectors(spark)
    got = embeddings.near_duplicates(df).toPandas()
    assert len(got) == df.count()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    by_id = got.dropna(subset=["vec_id"]).drop_duplicates("vec_id").set_index("vec_id")
    assert (by_id.loc[range(len(x))].n_links.to_numpy() == near.sum(1)).mean() > 0.995
    assert (by_id.loc[range(len(x))].component_id.to_numpy() == forest(len(x), *np.nonzero(near))).all()
    assert (by_id.loc[len(x) :].n_links == 0).all() and (got.dropna().kept == (got.dropna().vec_id == got.dropna().component_id)).all()
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_search_recalls_brute_force(spark):
    x, df = odd_vectors(spark)
    got = embeddings.search(df, every=50, nearest=5, block=64).toPandas()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = want = 0
    for q in range(0, len(x), 50):
        close = unit @ unit[q]
        close[q] = -2
        best = np.lexsort((np.arange(len(x)), -np.round(close, 12)))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(mine.score, close[mine.vec_id], atol=1e-12)
        hit, want = hit + len(set(best) & set(mine.vec_id)), want + 5
    assert hit >= 0.9 * want and set(got.query_id) == set(range(0, len(x), 50))
    few = embeddings.search(df.filter("vec_id < 3"), every=2).toPandas()
    assert sorted(few[["query_id", "vec_id"]].itertuples(index=False, name=None)) == [(0, 1), (0, 2), (2, 0), (2, 1)]
    assert embeddings.search(df.limit(0)).count() == 0


def test_walk_is_in_order_of_summed_distance():
    x = np.random.default_rng(1).standard_normal((500, 8))
    index = embeddings.MultiIndex(x, 8, 5, 0.95)
    counts = np.bincount(index.cells(x), minlength=index.size)
    a, b = (embeddings.squared(h, book) for h, book in zip(index.halves(x[:20]), index.books))
    for n, cells in enumerate(index.walk(x[:20], counts, 1e9)):
        d = (a[n][:, None] + b[n][None]).ravel()
        assert len(set(cells.tolist())) == index.size and (np.diff(d[cells]) >= -1e-12).all()


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (300, 301), (301, 300), (None, 4), (7, None)]
    got = connected_components(spark.createDataFrame(pd.DataFrame(edges, columns=["a", "b"]).astype("Int64").astype(object).where(lambda d: d.notna(), None).values.tolist(), "a long, b long"), "a", "b")
    found = {r["node"]: r["component"] for r in got.collect()}
    assert found == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 300: 300, 301: 300}
