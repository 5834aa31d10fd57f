"""Blocks of users against blocks of films: scores as matrices, so that no pair of them is a row of a shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIRS = "username string, slug string, score double"
Scores = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


def _frame(names: list, slugs: list, scores: list) -> pd.DataFrame:
    return pd.DataFrame({"username": pd.Series(names, dtype=object), "slug": pd.Series(slugs, dtype=object), "score": np.array(scores, float)})


def block_pairs(people: DataFrame, items: DataFrame, work: Callable, users_at_once: int, films_at_once: int) -> DataFrame:
    """work(block of people, block of items, by slug) for all pairs of blocks; a block travels once for each block of the other side."""
    n_u = max(1, -(-people.count() // users_at_once))
    n_f = max(1, -(-items.count() // films_at_once))
    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    people = people.withColumn("ub", block("username", n_u)).withColumn("fb", F.explode(F.sequence(F.lit(0), F.lit(n_f - 1))))
    items = items.withColumn("fb", block("slug", n_f)).withColumn("ub", F.explode(F.sequence(F.lit(0), F.lit(n_u - 1))))

    def run(u: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(u) or not len(f):
            return _frame([], [], [])
        return work(u, f.sort_values("slug", kind="stable").reset_index(drop=True))

    return people.groupBy("ub", "fb").cogroup(items.groupBy("ub", "fb")).applyInPandas(run, PAIRS)


def best_unseen(people: DataFrame, items: DataFrame, n: int, score: Scores, users_at_once: int = 256, films_at_once: int = 4096) -> DataFrame:
    """(username, slug, score): for each user the n best films of each block with a finite score, but those in `seen`; ties all."""

    def work(u: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        total = score(u, f)
        row = {s: j for j, s in enumerate(f["slug"])}
        for i, seen in enumerate(u["seen"]):
            total[i, [row[s] for s in (seen if seen is not None else ()) if s in row]] = -np.inf
        names, slugs, scores = [], [], []
        keep = min(n, len(f))
        for i, name in enumerate(u["username"]):
            bar = np.partition(total[i], len(f) - keep)[len(f) - keep]
            at = np.flatnonzero((total[i] >= bar - 1e-9) & np.isfinite(total[i]))
            names += [name] * len(at)
            slugs += [f["slug"].iloc[j] for j in at]
            scores += total[i, at].tolist()
        return _frame(names, slugs, scores)

    return block_pairs(people, items, work, users_at_once, films_at_once)


def every_pair(people: DataFrame, items: DataFrame, score: Scores, users_at_once: int = 256, films_at_once: int = 4096) -> DataFrame:
    """(username, slug, score) of all pairs: for results that grow with the pairs themselves."""

    def work(u: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        return _frame(np.repeat(u["username"].to_numpy(object), len(f)), np.tile(f["slug"].to_numpy(object), len(u)), score(u, f).ravel())

    return block_pairs(people, items, work, users_at_once, films_at_once)
