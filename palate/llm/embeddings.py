"""Near-duplicate vectors by random-hyperplane signs, and nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palate.llm.common import connected_components, forest, in_blocks, map_sorted_groups
from palate.sources.shared import shared_table

BLOCK = 1024  # vectors that one group compares at most, or twice as many where two blocks meet


def usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, v, dims) of the vectors that have a direction: no null or non-finite component, not all zero; each id and vector once."""
    own = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return own.filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False))).withColumn("dims", F.size("v")).distinct()


def unit(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def hyperplanes(dims: int, tables: int, bits: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, tables * bits))


def near_duplicates(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, recall: float = 0.999) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    Equal vectors are one node that counts with its number. Sign codes over `tables` sets of random hyperplanes bring
    nodes together; their number is such that a pair at just that cosine meets with probability `recall`, closer
    pairs more surely. In a group all cosines are computed in double precision, and a pair counts in the first table
    where it meets, so counts need no list of pairs. Components are linked across the cluster. Vectors of different
    length, null, zero or with null or non-finite components link with nothing; a null id has no component;
    repeated rows of one id and vector count once and are each returned."""
    own = usable(vectors, id_, vector)
    kind = own.schema["v"].dataType.simpleString()
    nodes = shared_table(own.groupBy("dims", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    n = nodes.count()
    bits = int(np.clip(np.ceil(np.log2(max(n, 1) / 512)), 2, 30))
    meet = (1 - np.arccos(cosine) / np.pi) ** bits
    tables = int(np.ceil(np.log(1 - recall) / np.log(1 - meet)))

    def codes(frames):
        powers = 1 << np.arange(bits)
        for f in frames:
            for dims, g in f.groupby("dims"):
                signs = (unit(g["v"]) @ hyperplanes(int(dims), tables, bits) > 0).reshape(len(g), tables, bits)
                yield g.assign(codes=list((signs @ powers).astype(np.int32)))

    coded = nodes.select("node", "copies", "dims", "v").mapInPandas(codes, f"node long, copies long, dims int, v {kind}, codes array<int>")
    keyed = coded.select("node", "copies", "dims", "v", F.posexplode("codes").alias("table", "code")).withColumn("key", F.xxhash64("dims", "table", "code")).drop("code")

    def all_codes(x: np.ndarray, upto: int) -> np.ndarray:
        return ((x @ hyperplanes(x.shape[1], tables, bits)[:, : upto * bits] > 0).reshape(len(x), upto, bits) @ (1 << np.arange(bits))).astype(np.int32)

    def compare(part: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame | None:
        out = []
        for lo, hi in zip(starts, np.append(starts[1:], len(part))):
            group = part.iloc[lo:hi]
            # a key is a hash: should two meet, vectors of each length and table are still compared apart
            for (_, table), at in group.groupby(["dims", "table"]).indices.items():
                g = group.iloc[at]
                x, block = unit(g["v"]), g["own"].to_numpy()
                a, b = np.nonzero(np.triu(x @ x.T >= cosine - 1e-9, 1))
                if not len(a):
                    continue
                some, place = np.unique(np.concatenate([a, b]), return_inverse=True)
                code = all_codes(x[some], int(table) + 1)  # of those in a pair: few, so codes needn't travel
                ca, cb = code[place[: len(a)]], code[place[len(a) :]]
                new = (np.einsum("ij,ij->i", x[a], x[b]) >= cosine) & (ca[:, table] == cb[:, table])
                new &= ~(ca[:, :table] == cb[:, :table]).any(axis=1)  # else the pair counts in an earlier table
                if g["block_a"].iloc[0] != g["block_b"].iloc[0]:
                    new &= block[a] != block[b]  # else it counts within its block
                a, b = a[new], b[new]
                if len(a):
                    copies, node = g["copies"].to_numpy(), g["node"].to_numpy()
                    links = np.bincount(a, copies[b], len(g)) + np.bincount(b, copies[a], len(g))
                    some = np.flatnonzero(links)
                    root = forest(len(g), a, b)
                    out.append(pd.DataFrame({"node": node[some], "links": links[some].astype(np.int64), "to": node[root[some]]}))
        return pd.concat(out) if out else None

    cut = in_blocks(keyed, "key", "node", BLOCK)
    found = shared_table(map_sorted_groups(cut, ["key", "block_a", "block_b"], compare, "node long, links long, to long", least=2 * BLOCK), "links")
    # components run over the smallest ids of equal vectors, so that the smallest of a component is its smallest id
    names = nodes.select("node", "id")
    edges = found.filter("node <> to").select("node", "to").distinct().join(names, "node").select(F.col("id").alias("a"), F.col("to").alias("node"))
    groups = connected_components(edges.join(names, "node").select("a", F.col("id").alias("b")), "a", "b").withColumnRenamed("node", "id")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    counted = nodes.join(links, "node", "left").join(groups, "id", "left").select(
        "dims", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    by_id = own.join(counted, ["dims", "v"]).groupBy(F.col("id").alias("vec_id")).agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    rows = vectors.select(F.col(id_).cast("long").alias("vec_id")).join(by_id, "vec_id", "left")
    rows = rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return rows.withColumn("kept", F.col("vec_id") == F.col("component_id"))


# All pairs, and the smallest id that a walk over links reaches.
ORACLE_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9
), r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(m, vec_id)) as component_id, vec_id = least(vec_id, coalesce(m, vec_id)) as kept
from embeddings left join (select a, count(*) as n from l group by a) x on x.a = vec_id left join (select a, min(b) as m from r group by a) y on y.a = vec_id
"""


# ---- nearest neighbours ----------------------------------------------------------------------------------------


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = squared(x, centres).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


class MultiIndex:
    """Codebooks of both halves of unit vectors; a cell is a pair of centroids.

    Fitted on a bounded sample, with the share of all rows that a search must pass to find its neighbours there."""

    def __init__(self, sample: np.ndarray, k: int, nearest: int, recall: float, probes: int = 256):
        self.half = sample.shape[1] // 2
        self.books = [k_means(x, k) for x in self.halves(sample)]
        cells = self.cells(sample)
        counts = np.bincount(cells, minlength=self.size)
        ask = np.random.default_rng(3).choice(len(sample), min(probes, len(sample)), replace=False)
        shares = []
        for q, order in zip(ask, self.orders(sample[ask])):
            close = sample @ sample[q]
            close[q] = -2
            passed = np.cumsum(counts[order])
            place = np.empty(self.size, int)
            place[order] = np.arange(self.size)
            best = np.argpartition(-close, min(nearest, len(close) - 1))[:nearest]
            shares += (passed[place[cells[best]]] / len(sample)).tolist()
        self.share = float(np.quantile(shares, recall)) if shares else 1.0

    @property
    def size(self) -> int:
        return len(self.books[0]) * len(self.books[1])

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (squared(h, book).argmin(axis=1) for h, book in zip(self.halves(x), self.books))
        return a * len(self.books[1]) + b

    def orders(self, x: np.ndarray):
        """For each vector all cells by the sum of both distances, as walk() would give them without an end."""
        far = [squared(h, book) for h, book in zip(self.halves(x), self.books)]
        for a, b in zip(*far):
            yield np.argsort((a[:, None] + b[None, :]).ravel(), kind="stable")

    def walk(self, x: np.ndarray, counts: np.ndarray, least: float):
        """For each vector the cells in order of summed distance until they hold `least` rows: the multi-sequence
        algorithm, whose heap holds the frontier of centroid pairs."""
        wide = len(self.books[1])
        far = [squared(h, book) for h, book in zip(self.halves(x), self.books)]
        for a, b in zip(*far):
            ia, ib = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
            da, db = a[ia].tolist(), b[ib].tolist()
            heap, passed, seen = [(da[0] + db[0], 0, 0)], 0, []
            done = [0] * len(ia)  # columns passed in each row
            while heap and passed < least:
                _, i, j = heapq.heappop(heap)
                cell = ia[i] * wide + ib[j]
                seen.append(cell)
                passed += counts[cell]
                done[i] = j + 1
                if i + 1 < len(ia) and done[i + 1] == j:
                    heapq.heappush(heap, (da[i + 1] + db[j], i + 1, j))
                if j + 1 < len(ib) and (i == 0 or done[i - 1] > j + 1):
                    heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            yield np.array(seen)


def search(
    vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", every: int = 50, nearest: int = 5, recall: float = 0.985,
    sample_rows: int = 16_384, block: int = 2048, queries_at_once: int = 2048,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `nearest` rows of largest cosine for each row whose id is divisible by `every`.

    An inverted multi-index: both halves of the unit vectors are quantised apart, every row goes to the cell of its
    two centroids, and a query passes cells in order of summed distance until they hold a certain share of all rows;
    those rows are compared exactly. Codebooks and share come from the sample_rows rows of smallest hash, the share
    such that the sample's own neighbours are found with probability `recall`; a codebook has 1,024 centroids at most,
    for about 6 x 10^7 rows and more, and then needs a sample of 32 rows for each. Cells are gathered in blocks of about
    `block` rows, larger ones split, and a query goes only to the blocks that hold cells it passes; a block is copied
    once for each queries_at_once queries that it gets.
    Vectors of another length than the most frequent one, null, zero or with null or non-finite components take no
    part; of several vectors with one id all take part, but never answer a query of their own id. Ties go to the
    smaller id."""
    own = usable(vectors, id_, vector)
    common = own.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    spark = vectors.sparkSession
    if not common:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, total = common["dims"], common["count"]
    own = own.filter(F.col("dims") == dims).select("id", "v")
    k = int(2 ** np.clip(np.round(np.log2(max(total, 1) / 64) / 2), 2, 10))
    sample_rows = max(sample_rows, 32 * k)
    sample = own.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas().sort_values("id", kind="stable")  # sample_rows at most
    index = MultiIndex(unit(sample["v"]), k, nearest, recall)
    kind = own.schema["v"].dataType.simpleString()

    def quantise(frames):
        for f in frames:
            yield f.assign(cell=index.cells(unit(f["v"])) if len(f) else np.zeros(0, np.int64))

    entries = shared_table(own.mapInPandas(quantise, f"id long, v {kind}, cell long"), "entries")
    counts = np.zeros(index.size, np.int64)
    for r in entries.groupBy("cell").count().collect():  # index.size rows at most, whatever the table
        counts[r["cell"]] = r["count"]
    # neighbouring cells share a block; a large cell has several
    parts = np.maximum(1, -(-counts // block))
    first = np.zeros(index.size, np.int64)
    at, room = -1, 0
    for c in range(index.size):
        if parts[c] > 1 or counts[c] > room:
            at += 1
            first[c], room = at, block - counts[c]
            at += int(parts[c]) - 1
            room = 0 if parts[c] > 1 else room
        else:
            first[c], room = max(at, 0), room - counts[c]
    least = index.share * total

    def deal(frames):
        for f in frames:
            cell = f["cell"].to_numpy()
            spread = pd.util.hash_array(f["id"].to_numpy()) % parts[cell].astype(np.uint64) if len(f) else np.zeros(0, np.uint64)
            yield pd.DataFrame({"block": first[cell] + spread.astype(np.int64), "id": f["id"], "v": f["v"], "cell": cell})

    def route(frames):
        for f in frames:
            for q, v, seen in zip(f["id"], f["v"], index.walk(unit(f["v"]), counts, least) if len(f) else []):
                seen = seen[counts[seen] > 0]
                to = np.concatenate([np.arange(first[c], first[c] + parts[c]) for c in seen])
                of = np.repeat(seen, parts[seen])
                order = np.argsort(to, kind="stable")
                at, begin = np.unique(to[order], return_index=True)
                yield pd.DataFrame({"block": at, "query_id": q, "v": [v] * len(at), "cells": np.split(of[order], begin[1:])})

    asked = entries.filter(F.col("id") % every == 0).select("id", "v").mapInPandas(route, f"block long, query_id long, v {kind}, cells array<long>")
    asked = shared_table(asked, "asked")
    wanted = asked.groupBy("block").agg(F.ceil(F.count("*") / queries_at_once).cast("int").alias("parts"))
    dealt = entries.mapInPandas(deal, f"block long, id long, v {kind}, cell long").join(wanted, "block")
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    asked = asked.join(wanted, "block").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("parts")

    def compare(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, y = unit(queries["v"]), unit(rows["v"])
        ids, query, cell = rows["id"].to_numpy(), queries["query_id"].to_numpy(), rows["cell"].to_numpy()
        out = []
        for i, cells in enumerate(queries["cells"]):
            able = np.flatnonzero(np.isin(cell, cells) & (ids != query[i]))
            close = y[able] @ x[i]
            if len(able) > nearest:
                bar = np.partition(close, len(close) - nearest)[len(close) - nearest]
                able = able[close >= bar - 1e-9]
            score = np.einsum("ij,j->i", y[able], x[i])
            best = np.lexsort((ids[able], -score))[:nearest]
            out.append(pd.DataFrame({"query_id": query[i], "vec_id": ids[able][best], "score": score[best]}))
        return pd.concat(out)

    near = dealt.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(compare, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
