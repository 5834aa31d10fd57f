"""Helpers that several operators share: connected components, sorted group maps, text maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palate.sources.shared import forget, shared_table

def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """So many rows at a time. Spark bounds a batch by bytes; what Python makes of whole texts takes several times that."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_size(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many bytes each, or of one row."""
    for batch in batches:
        if batch.nbytes <= size or batch.num_rows < 2:
            yield batch
        else:
            half = batch.num_rows // 2
            yield from by_size((batch.slice(0, half), batch.slice(half)), size)


def map_texts(
    df: DataFrame, schema: str, work: Callable[[list[list]], list[tuple]], rows: int = 256, setup: Callable | None = None, size: int | None = None
) -> DataFrame:
    """For each slice of an Arrow batch, work() gets the columns as lists and returns result rows as tuples, in the schema's order.

    setup() runs once in a task and gives the state that work gets as its second argument. size: slices hold so many bytes
    at most, or one row."""
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        cut = slices(batches, rows)
        for batch in by_size(cut, size) if size else cut:
            columns = [c.to_pylist() for c in batch.columns]
            out = work(columns, state) if setup else work(columns)
            if out:
                parts = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(p, f.type) for p, f in zip(parts, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def map_sorted_groups(
    df: DataFrame, keys: list[str], work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame | None], schema: str, least: int = 50_000
) -> DataFrame:
    """Rows dealt out and sorted by keys; work() gets whole groups, `least` rows or more at a time, and where each begins.

    For many small groups this saves the cost that applyInPandas has for each. A group must fit in memory."""

    def begins(part: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(part), bool)
        change[0] = True
        for k in keys:
            v = part[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n >= least:
                part = pd.concat(held, ignore_index=True)
                starts = begins(part)
                last = starts[-1]  # this group may go on
                held, n = [part.iloc[last:]], 0
                if last:
                    out = work(part.iloc[:last], starts[:-1])
                    if out is not None and len(out):
                        yield out
        held = [h for h in held if len(h)]
        if held:
            part = pd.concat(held, ignore_index=True)
            out = work(part, begins(part))
            if out is not None and len(out):
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def in_blocks(df: DataFrame, key: str, id_: str, limit: int) -> DataFrame:
    """df with own (a row's block), block_a and block_b, so that the groups of (key, block_a, block_b) are small and any two rows of one key meet.

    A key of up to `limit` rows is one group. A larger one is cut into blocks by the hash of id_, and each pair of
    blocks is a group. Only keys over the limit are counted out to the join, so their table stays small."""
    large = df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    blocks = large.select(key, F.ceil(F.col("n") / limit).cast("int").alias("blocks"))
    cut = df.join(blocks, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64(id_), F.col("blocks")).cast("int")
    cut = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.withColumn("block_a", F.least("own", "other")).withColumn("block_b", F.greatest("own", "other")).drop("other", "blocks")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each of n nodes' component under the links a-b, all numbered from 0."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = lo != hi
        if not open_.any():
            break
        a, b, lo, hi = a[open_], b[open_], lo[open_], hi[open_]
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for each node with an edge to another.

    Alternating large and small stars: each node hands its neighbours to the smallest of them until only stars
    remain, in about log(n) rounds. A round's edges are a table in the shared folder."""

    def tidy(df: DataFrame) -> DataFrame:
        return df.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    now = shared_table(tidy(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last = mark(now)
    while last[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = shared_table(large, "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = shared_table(tidy(small.unionByName(low.select("u", F.col("m").alias("v")))), "edges")
        forget(now, large)
        now, before = then, last
        last = mark(now)
        if last == before:
            break
    # a star: each leaf once, under the centre, which is the smallest
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def unused(name: str, columns: list[str]) -> str:
    """name, with as many underscores before it as it takes to be no one of the columns."""
    while name in columns:
        name = "_" + name
    return name


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
