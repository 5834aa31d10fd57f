"""Best partners by what two have in common: an inverted index whose most frequent entries are left out where a bound allows it.

Users who rate the same films, or films that the same users rate, are pairs whose number grows with the square of a
frequent entry. Here a pair is never a row of a shuffle: a block of ones meets the postings of its entries, sums of common
entries are matrices in a task, and only the best of each block leave it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palate.sources.shared import shared_table

Columns = dict[str, np.ndarray]
Sums = Callable[[Columns, Columns], list[np.ndarray]]  # of each common entry, what is to be summed
Products = list[tuple[Callable[[Columns], np.ndarray], Callable[[Columns], np.ndarray]]]  # the same where each is a product
Choice = Callable[[Columns, Columns, list[np.ndarray]], tuple]  # (rows, columns, further columns) that leave the task

POSTINGS = 8192  # of an entry's postings that one row of the join has at most, about
WITHIN = 33  # bits of a number inside its block


def ordered_entries(entries: DataFrame) -> DataFrame:
    """entries (one, what, ...) with `many`, how many have what, and `place`, from 1 for the most frequent of one's entries."""
    counts = entries.groupBy("what").agg(F.count("*").alias("many"))
    return entries.join(counts, "what").withColumn("place", F.row_number().over(Window.partitionBy("one").orderBy(F.desc("many"), "what")))


def dealt(entries: DataFrame, values: list[str], indexed: Column | None, asked: DataFrame | None, at_once: int, met_at_once: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(numbered, left, right) for meet(): numbers of ones, a block's own entries and the postings that travel to it, both in arrays."""
    entries = shared_table(entries, "entries")
    names = entries.select("one").distinct()
    blocks = max(1, -(-names.count() // at_once))
    numbered = names.repartitionByRange(blocks, "one").sortWithinPartitions("one").withColumn("id", F.monotonically_increasing_id())
    numbered = shared_table(numbered, "numbers")  # stored, so a number stays
    mine = entries if indexed is None else entries.filter(indexed)
    if asked is not None:
        mine = mine.join(asked.select("one").distinct(), "one", "left_semi")
    salts = F.ceil(F.col("many") / POSTINGS).cast("int")
    mine = mine.join(numbered, "one").select(F.shiftright("id", WITHIN).cast("int").alias("a"), "id", "what", "many", salts.alias("salts"), *values)
    left = shared_table(mine.groupBy("a", "what", "many", "salts").agg(F.collect_list(F.struct("id", *values)).alias("own")), "own")
    most = left.groupBy("a").agg(F.sum("many").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-most // met_at_once))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("b")
    salt = F.pmod(F.xxhash64("id", F.lit("salt")), salts).cast("int").alias("salt")
    theirs = entries.join(numbered, "one").select("what", part, salt, F.struct("id", *values).alias("p"))
    theirs = theirs.groupBy("what", "b", "salt").agg(F.collect_list("p").alias("p"))
    packed = theirs.select("what", "salt", "b", *[F.col(f"p.{c}").alias(f"of_{c}") for c in ("id", *values)])
    wanted = left.select(F.col("a").alias("to"), "what", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    right = packed.join(wanted, ["what", "salt"]).drop("salt").withColumnRenamed("what", "entry")
    left = left.select("a", "what", *[F.col(f"own.{c}").alias(c) for c in ("id", *values)])
    return numbered, left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), right


def meet(
    entries: DataFrame, values: list[str], sums: Sums | Products, choose: Choice, schema: str, indexed: Column | None = None, asked: DataFrame | None = None, at_once: int = 1024,
    met_at_once: int = 2_000_000,
) -> DataFrame:
    """What choose() takes of the pairs of ones that have an indexed entry in common: (one, other, ...) by schema.

    entries: (one, what, many, place, *values) as ordered_entries() gives them, each (one, what) once. indexed: which of
    a one's entries bring others to it, all if none; the others' postings are whole. asked: (one), whose partners are
    wanted; all if none.

    Ones are numbered in the order of their names, about `at_once` to a block; neighbours in that order often have
    entries in common. An entry's postings are arrays of numbers that travel once to each block that has the entry in the
    index, whatever the number of blocks; those of a frequent entry are several rows. Where a block would meet more than
    met_at_once postings, the others are dealt over several tasks, each with the whole block. Sums of products are matrix
    products where few different entries meet, so that frequent ones cost no more than rare ones."""
    numbered, left, right = dealt(entries, values, indexed, asked, at_once, met_at_once)
    out = [c.strip().split() for c in schema.split(",")]
    made = ", ".join(f"{c} {'long' if k < 2 else kind}" for k, (c, kind) in enumerate(out))

    def work(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:  # noqa: E741
        none = pd.DataFrame({c: [] for c, _ in out})
        if not len(l) or not len(r):
            return none
        what, known = pd.factorize(r["entry"])
        place = pd.Index(known).get_indexer(l["what"])
        l, place = l[place >= 0], place[place >= 0]  # noqa: E741
        if not len(l):
            return none
        place, x = np.repeat(place, l["id"].map(len).to_numpy()), {c: np.concatenate(l[c].to_numpy()) for c in ("id", *values)}
        what, y = np.repeat(what, r["of_id"].map(len).to_numpy()), {c: np.concatenate(r[f"of_{c}"].to_numpy()) for c in ("id", *values)}
        order = np.argsort(what, kind="stable")
        what, y = what[order], {c: v[order] for c, v in y.items()}
        order = np.argsort(x["id"], kind="stable")
        place, x = place[order], {c: v[order] for c, v in x.items()}
        ones, one = np.unique(x["id"], return_inverse=True)
        others, first, other = np.unique(y["id"], return_index=True, return_inverse=True)
        about_one, about_other = ({c: v[at] for c, v in f.items()} for f, at in ((x, np.searchsorted(x["id"], ones)), (y, first)))
        begins = np.searchsorted(what, np.arange(len(known) + 1))
        n = begins[place + 1] - begins[place]
        upto, first_of = np.append(0, np.cumsum(n)), np.searchsorted(one, np.arange(len(ones) + 1))
        narrow = isinstance(sums, list) and len(known) <= 8192 and len(known) * len(others) <= 1 << 24
        dense = narrow and 2 * len(ones) * len(others) * len(known) * (len(sums) + 1) < 1000 * upto[-1]  # a common entry costs some hundred times what a product in a matrix does
        sparse = upto[-1] < 0.1 * len(ones) * len(others)  # one at a time, against only those that it meets
        cells = max(at_once * at_once, len(others))
        took = []
        yours = []
        if dense:
            for g in (None, *(g for _, g in sums)):
                m = np.zeros((len(others), len(known)))
                m[other, what] = g(y) if g else 1
                yours.append(m.T)
        at = 0
        while at < len(ones):
            to = at + 1 if sparse else min(len(ones), at + max(1, cells // len(others)))
            while not dense and to > at + 1 and upto[first_of[to]] - upto[first_of[at]] > 4_000_000:
                to = at + (to - at) // 2
            some = slice(first_of[at], first_of[to])
            near = slice(None)
            if dense:
                found = []
                for k, m in enumerate(yours):
                    own = np.zeros((to - at, len(known)))
                    own[one[some] - at, place[some]] = sums[k - 1][0]({c: v[some] for c, v in x.items()}) if k else 1
                    found.append(own @ m)
            else:
                m = n[some]
                i = np.repeat(np.arange(some.start, some.stop), m)
                j = np.repeat(begins[place[some]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                at_other = other[j]
                if sparse:
                    near, at_other = np.unique(at_other, return_inverse=True)
                wide = len(near) if sparse else len(others)
                left_, right_ = {c: v[i] for c, v in x.items()}, {c: v[j] for c, v in y.items()}
                sums_ = [f(left_) * g(right_) for f, g in sums] if isinstance(sums, list) else sums(left_, right_)
                cell = (one[i] - at) * wide + at_other
                found = [np.bincount(cell, w, (to - at) * wide).reshape(to - at, wide) for w in (None, *sums_)]
                found[0] = found[0].astype(float)
            met = others[near]
            if len(met):
                own = np.searchsorted(met, ones[at:to])
                self_ = np.flatnonzero(met[np.minimum(own, len(met) - 1)] == ones[at:to])
                found[0][self_, own[self_]] = 0  # no one is its own partner
                rows, columns, *rest = choose({c: v[at:to] for c, v in about_one.items()}, {c: v[near] for c, v in about_other.items()}, found)
                took.append((ones[at + rows], met[columns], *rest))
            at = to
        return pd.DataFrame({c: np.concatenate(p) for (c, _), p in zip(out, zip(*took))}) if took else none

    found = left.groupBy("a", "part").cogroup(right.groupBy("to", "b")).applyInPandas(work, made)
    for c, _ in out[:2]:
        found = found.withColumnRenamed(c, "id").join(numbered.withColumnRenamed("one", f"name of {c}"), "id").drop("id").withColumnRenamed(f"name of {c}", c)
    return found.select(*[c for c, _ in out])


def best_in_rows(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each row's k largest finite scores, ties at the last all."""
    keep = min(k, score.shape[1])
    bar = np.partition(score, score.shape[1] - keep, axis=1)[:, score.shape[1] - keep]
    return np.nonzero((score >= bar[:, None] - 1e-9) & np.isfinite(score))
