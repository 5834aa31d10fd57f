"""Alternating least squares, stored models, and streams whose state is retracted."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from palate.operators import queue as Q
from palate.sources import models
from palate.streaming import jobs


def low_rank(n=40, m=30, seed=3):
    rng = np.random.default_rng(seed)
    x = 3 + rng.normal(size=(n, 2)) @ rng.normal(size=(2, m)) * 0.6
    return [(f"u{i}", f"f{j}", float(x[i, j])) for i in range(n) for j in range(m)], rng


def test_als_predicts_what_is_held_out(spark):
    rows, rng = low_rank()
    held = rng.random(len(rows)) < 0.2
    matrix = spark.createDataFrame([r for r, h in zip(rows, held) if not h], "username string, slug string, value double")
    pairs = spark.createDataFrame([r for r, h in zip(rows, held) if h], "username string, slug string, value double")
    error = {}
    for name, fit in (("als", Q.fit_als), ("svd", Q.fit_svd)):
        users, items = fit(matrix, 2)
        got = Q.predict_svd(pairs, Q.bias_model(matrix), users, items).join(pairs, ["username", "slug"])
        error[name] = got.agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("value"), 2)))).first()[0]
    assert error["als"] < 0.35 and error["als"] < error["svd"]  # what isn't stored is unknown, not zero
    users, items = Q.fit_als(matrix, 2)
    seen = matrix.select("username", "slug")
    best = Q.recommend_svd(Q.bias_model(matrix), users, items, seen, n=3).collect()
    assert len(best) > 60 and not {(r["username"], r["slug"]) for r in best} & {(r[0], r[1]) for r, h in zip(rows, held) if not h}


def test_numbers_have_no_gaps(spark):
    names = spark.createDataFrame([(f"n{i % 70}",) for i in range(200)] + [(None,)], "name string").repartition(5)
    got = Q.numbered(names, "name").collect()
    assert sorted(r["number"] for r in got) == list(range(70)) and len({r["name"] for r in got}) == 70


def test_a_stored_model_is_fitted_once(spark, tmp_path):
    rows, _ = low_rank(6, 5)
    fits = []

    def run(rows, **params):
        matrix = spark.createDataFrame(rows, "username string, slug string, value double")

        def fit():
            fits.append(1)
            return {"means": matrix.groupBy("slug").agg(F.avg("value").alias("mean")), "users": matrix.select("username").distinct()}

        said = Q.model_fingerprint(matrix, **params).crossJoin(models.digest(matrix))
        tables = models.stored_model((tmp_path / "model").as_uri(), said, fit)
        assert tables["users"].count() == 6 and tables["means"].count() == 5
        return {r["slug"]: r["mean"] for r in tables["means"].collect()}

    first = run(rows, factors=2)
    assert run(rows[::-1], factors=2) == first and len(fits) == 1  # in any order
    changed = [(*rows[0][:2], rows[0][2] + 1), *rows[1:]]
    assert run(changed, factors=2) != first and len(fits) == 2  # one rating
    run(changed, factors=3)
    assert len(fits) == 3
    (tmp_path / "model" / "v=3" / "fingerprint" / "_SUCCESS").unlink()  # a writer that was cut short
    assert run(changed, factors=2) != first and len(fits) == 3
    run(rows, factors=2)
    assert len(fits) == 4 and sorted(p.name for p in (tmp_path / "model").iterdir() if p.name.startswith("v=")) == ["v=2", "v=3"]


VALUES = "slug string, version long, values array<struct<attr_type: string, attr_value: string>>"


def test_documents_are_counted_once_however_often_they_come(spark):
    def wave(*films):
        return spark.createDataFrame([(s, n, None if v is None else [("genre", x) for x in v]) for s, n, v in films], VALUES)

    waves = [
        wave(("a", 1, "xy"), ("b", 1, "x"), ("c", 1, "z")),
        wave(("a", 2, "yw"), ("b", 1, "q"), ("d", 1, "x"), (None, 1, "x")),  # a changes, b is no newer
        wave(("a", 1, "xx"), ("c", 3, None), ("d", 1, "x"), ("d", 2, "xxz")),  # a is older, c has none any more
    ]
    got = {r["attr_value"]: (r["doc_count"], round(r["idf"], 9)) for r in jobs.run_idf(jobs.as_waves(waves)).collect()}
    idf = lambda n: round(float(np.log(4 / (1 + n))), 9)
    assert got == {"y": (1, idf(1)), "w": (1, idf(1)), "x": (2, idf(2)), "z": (1, idf(1))}


def test_late_rows_are_dropped_and_windows_close(spark):
    at = lambda h, m=0: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=m)
    frame = lambda rows: spark.createDataFrame(rows, "user_id long, ts timestamp")
    waves = [
        frame([(1, at(0)), (1, at(0, 10)), (2, at(1, 5))]),
        frame([(1, at(9)), (1, at(9, 20))]),
        frame([(1, at(9, 30))]),
        frame([(1, at(2)), (1, at(9, 40))]),  # the first comes hours after the watermark has passed it
        frame([(3, at(50))]),
    ]
    sessions = jobs.session_status(jobs.run_to_table(jobs.stream_sessions(jobs.as_waves(waves, 1), delay="1 hour"), "append"))
    got = sorted((r["user_id"], r["started"], r["ended"], r["n_events"], r["status"]) for r in sessions.collect())
    assert got == [(1, at(0), at(0, 40), 2, "steady"), (1, at(9), at(10, 10), 4, "steady"), (2, at(1, 5), at(1, 35), 1, "single")]
    rates = jobs.run_to_table(jobs.stream_rates(jobs.as_waves(waves, 1), delay="1 hour"), "append")
    assert sorted((r["started"], r["n_events"], r["per_hour"]) for r in rates.collect()) == [(at(0), 2, 2.0), (at(1), 1, 1.0), (at(9), 4, 4.0)]
