"""Near-duplicate documents by SimHash: shards of fingerprints, each searched through a BK-tree."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palate.llm.common import connected_components, forest, in_blocks, map_sorted_groups, map_texts, unused
from palate.sources.shared import shared_table

BINS = 64  # of a text's shingles, counted
SHARD = 2048  # fingerprints in a shard's tree at most


def shingles(text: str | None, words: int) -> list[bytes]:
    """All runs of so many words, repeats included, joined by blanks; of a shorter text the whole; of none nothing.

    Upper-case A-Z count as lower case; words are cut at blanks and the control characters 9 to 13."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return []
    joined = b" ".join(w)
    if len(w) <= words:
        return [joined]
    ends = np.cumsum([len(x) + 1 for x in w]).tolist()
    starts = [0, *ends[: len(w) - words]]
    return [joined[a : b - 1] for a, b in zip(starts, ends[words - 1 :])]


def fingerprint(text: str | None, words: int, seeds: tuple[int, ...], distinct: bool = False) -> list[int]:
    """A 64-bit number for each seed: a bit is 1 if over half the shingles' XXH64 have it; distinct counts repeats once."""
    runs = shingles(text, words)
    if distinct:
        runs = list(set(runs))
    out = []
    for seed in seeds:
        h = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), np.uint64, len(runs))
        n = np.zeros(64, np.int64)
        for a in range(0, len(h), 4096):
            n += np.unpackbits(h[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * n > len(h), bitorder="little").tobytes(), "little", signed=True))
    return out


class BKTrees:
    """BK-trees of many shards at once. A node's children have different Hamming distances to it; a fingerprint goes
    down the child at its own distance until there is none, and becomes that child. prints: (n, words) of 64 bits."""

    def __init__(self, prints: np.ndarray, starts: np.ndarray):
        n = len(prints)
        self.prints = prints
        self.root = np.repeat(starts, np.diff(np.append(starts, n)))
        edge, parent = np.zeros(n, np.int64), np.full(n, -1)
        rest = np.setdiff1d(np.arange(n), starts, assume_unique=True)
        at = self.root[rest]
        while len(rest):
            d = self.distance(rest, at)
            key = at * (64 * prints.shape[1] + 1) + d
            _, first, which = np.unique(key, return_index=True, return_inverse=True)
            edge[rest[first]], parent[rest[first]] = d[first], at[first]
            down = np.ones(len(rest), bool)
            down[first] = False
            at, rest = rest[first][which][down], rest[down]
        self.child = np.argsort(parent, kind="stable")[len(starts) :]  # by parent
        self.edge = edge
        self.begin = np.searchsorted(parent[self.child], np.arange(n + 1))

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.prints[a] ^ self.prints[b]).sum(axis=1, dtype=np.int64)

    def within(self, radius: int, step: int = 20_000):
        """Links (query, node) of one shard at `radius` or less, query after node: only edges within the radius are followed."""
        for low in range(0, len(self.root), step):
            query = np.arange(low, min(low + step, len(self.root)))
            node = self.root[query]
            while len(query):
                d = self.distance(query, node)
                hit = (d <= radius) & (node < query)
                if hit.any():
                    yield query[hit], node[hit]
                n = self.begin[node + 1] - self.begin[node]
                query, d = np.repeat(query, n), np.repeat(d, n)
                place = np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[node], n)
                node = self.child[place]
                near = np.abs(self.edge[node] - d) <= radius
                query, node = query[near], node[near]


def block_tables(bits: int, radius: int, extra: int = 2) -> list[list[int]]:
    """Bit places of the tables' keys: radius + extra blocks of bits, and a table for any `extra` of them.

    At `radius` or fewer differing bits at least `extra` blocks agree, so any such pair shares a key: no link is lost."""
    blocks = np.array_split(np.arange(bits), radius + extra)
    return [np.concatenate(c).tolist() for c in combinations(blocks, extra)]


def sampled_tables(bits: int, radius: int, rows: int, recall: float = 0.98) -> list[list[int]]:
    """For a radius too wide for blocks: keys of log2(rows / 64) random bits, in as many tables as give that recall at
    the radius itself, whatever the number of rows."""
    width = int(np.clip(np.ceil(np.log2(max(rows, 1) / 64)), 6, 28))
    agree = (1 - radius / bits) ** width
    n = int(np.ceil(np.log(1 - recall) / np.log(1 - agree)))
    pick = np.random.default_rng(7)
    return [pick.choice(bits, width, replace=False).tolist() for _ in range(n)]


def link_fingerprints(nodes: DataFrame, tables: list[list[int]], radius: int) -> DataFrame:
    """Links (a, b) between ids whose fingerprints differ in `radius` bits at most, enough of them to span each group.

    nodes: id long, fp array<long>. A shard is what shares a table's key; its tree goes with it through the shuffle,
    since trees of all fingerprints would outgrow any broadcast. Shards over SHARD are met by pairs of blocks."""

    def keys(frames):
        for f in frames:
            if len(f):
                prints = np.array(f["fp"].tolist(), np.int64).view(np.uint8).reshape(len(f), -1)
                bits = np.unpackbits(prints, axis=1, bitorder="little").astype(np.int64)
                k = np.stack([(i << 40) + bits[:, t] @ (1 << np.arange(len(t))) for i, t in enumerate(tables)], axis=1)
                yield pd.DataFrame({"id": f["id"], "fp": f["fp"], "keys": list(k)})

    keyed = nodes.mapInPandas(keys, "id long, fp array<long>, keys array<long>").select("id", "fp", F.explode("keys").alias("key"))

    def search(part: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame | None:
        size = np.diff(np.append(starts, len(part)))
        keep = np.repeat(size > 1, size)
        if not keep.any():
            return None
        part, size = part[keep], size[size > 1]
        prints = np.array(part["fp"].tolist(), np.int64).view(np.uint64)
        trees = BKTrees(prints, np.cumsum(size) - size)
        links = list(trees.within(radius))
        if not links:
            return None
        root = forest(len(part), np.concatenate([q for q, _ in links]), np.concatenate([n for _, n in links]))
        own = np.flatnonzero(root != np.arange(len(part)))
        ids = part["id"].to_numpy()
        return pd.DataFrame({"a": ids[own], "b": ids[root[own]]})

    return map_sorted_groups(in_blocks(keyed, "key", "id", SHARD), ["key", "block_a", "block_b"], search, "a long, b long")


def text_hash() -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fingerprints(docs: DataFrame, words: int, seeds: tuple[int, ...], distinct: bool = False) -> DataFrame:
    """(doc_id, version, fp, content): a hash of each whole text, its fingerprints and a hash of its words; a shared table."""
    def work(columns: list[list]) -> list[tuple]:
        return [(k, v, fingerprint(t, words, seeds, distinct), xxhash.xxh3_128_hexdigest(b" ".join(shingles(t, 1)))) for k, v, t in zip(*columns)]

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("version"), "text")
    return shared_table(map_texts(kept, "doc_id long, version long, fp array<long>, content string", work), "fingerprints")


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs: component_id is the smallest id reachable over
    fingerprints that differ in `radius` bits or less.

    Rows of one fingerprint are one node, so copies cost nothing further. A null or blank text has fingerprint zero
    and links like any other; a null id keeps its fingerprint, links nothing and has a null component; repeated rows
    give repeated results."""
    prints = fingerprints(docs, words, (seed,))
    nodes = shared_table(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    links = link_fingerprints(nodes, block_tables(64, radius), radius)
    found = connected_components(links, "a", "b")
    named = nodes.join(found, nodes["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    shown = F.lower(F.lpad(F.hex(F.element_at("fp", 1)), 16, "0"))
    return prints.join(named, "fp", "left").select(
        "doc_id", shown.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def rare_keys(text: str | None, words: int, similarity: float) -> tuple[int, list[int], bytes]:
    """(m, keys, counts): the number of distinct shingles, the smallest of their hashes and how many fall into each of
    BINS bins. A text that reaches the similarity has needed() of these keys or more in common with this one."""
    h = np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, set(shingles(text, words))), np.uint64))
    m = len(h)
    keys = h[: m - at_least(similarity * m) + at_least((1 - similarity) / 2 * m)]
    counts = np.minimum(np.bincount((h & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 255)
    return m, keys.view(np.int64).tolist(), counts.astype(np.uint8).tobytes()


def at_least(x: float) -> int:
    return int(np.ceil(x - 1e-6))


def needed(m: int, similarity: float) -> int:
    """The other text has similarity * m shingles or more, and so kept as many keys beyond what may differ."""
    return at_least((1 - similarity) / 2 * similarity * m)


def shared_keys(docs: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) that connect any two nodes of different groups with that Jaccard similarity, and others: pairs with a rare
    key in common, whose sizes and counts allow it. nodes: (id, doc_id, version, group).

    Of two similar texts' smallest hashes so many agree that each has one of the other's among its rarest, all but
    needed() - 1 of those that any other text has. Links of one key are enough to span its groups."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("version"), "text")
    texts = texts.join(nodes.select("id", "doc_id", "version"), ["doc_id", "version"]).select("id", "text")

    def work(columns: list[list]) -> list[tuple]:
        return [(i, *rare_keys(t, words, similarity)) for i, t in zip(*columns)]

    kept = shared_table(map_texts(texts, "id long, m int, keys array<long>, counts binary", work), "keys")
    keyed = kept.select("id", "m", F.explode("keys").alias("key"))
    often = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    mine = keyed.join(often, "key").groupBy("id").agg(F.first("m").alias("m"), F.array_sort(F.collect_set(F.struct("n", "key"))).alias("shared"))
    need = F.greatest(F.ceil(F.col("m") * ((1 - similarity) / 2 * similarity) - 1e-6).cast("int"), F.lit(1))
    rare = mine.withColumn("need", need).filter("size(shared) >= need").select("id", F.explode(F.expr("slice(shared, 1, size(shared) - need + 1)")).alias("s")).select("id", "s.key")
    rare = shared_table(rare.join(nodes.select("id", "group"), "id"), "rare")
    apart = rare.groupBy("key").agg(F.min("group").alias("a"), F.max("group").alias("b")).filter("a < b").select("key")  # what one group has is linked
    met = in_blocks(rare.join(apart, "key").join(kept.select("id", "m", "counts").dropDuplicates(["id"]), "id"), "key", "id", SHARD)
    may_differ = (1 - similarity) / (1 + similarity)

    def search(part: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame | None:
        size = np.diff(np.append(starts, len(part)))
        keep = np.repeat(size > 1, size)
        if not keep.any():
            return None
        part, size = part[keep], size[size > 1]
        ids, of, m = part["id"].to_numpy(), part["group"].to_numpy(), part["m"].to_numpy().astype(np.int64)
        counts = np.frombuffer(b"".join(part["counts"]), np.uint8).reshape(-1, BINS).astype(np.int16)
        links, last = [], np.repeat(np.cumsum(size), size)  # where each row's key ends
        for step in range(1, int(size.max())):  # each row with the one so many rows on
            a = np.flatnonzero((np.arange(len(part)) + step)[: len(part) - step] < last[: len(part) - step])
            b = a + step
            ok = of[a] != of[b]
            a, b = a[ok], b[ok]
            ok = np.minimum(m[a], m[b]) >= similarity * np.maximum(m[a], m[b]) - 1e-6
            a, b = a[ok], b[ok]
            for low in range(0, len(a), 20_000):
                x, y = a[low : low + 20_000], b[low : low + 20_000]
                near = np.abs(counts[x] - counts[y]).sum(axis=1, dtype=np.int64) <= may_differ * (m[x] + m[y]) + 1e-6
                links.append((x[near], y[near]))
        if not links:
            return None
        root = forest(len(ids), np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]))
        own = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[own], "b": ids[root[own]]})

    return map_sorted_groups(met.select("id", "group", "m", "counts", "key", "block_a", "block_b"), ["key", "block_a", "block_b"], search, "a long, b long", least=5000)


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, seeds: tuple[int, int] = (42, 43)) -> DataFrame:
    """(doc_id, version, stays) for each document, an id with a text: whether it is the smallest of its group, linked by a
    Jaccard similarity of their shingles.

    128-bit fingerprints give candidates: at that similarity they differ in about angle / pi of the bits, and the radius
    allows for two standard deviations more. Pairs that differ in more bits, or meet in no table, are found by shared_keys(),
    which misses none. Each candidate group is then linked anew by exact similarities."""
    prints = fingerprints(docs, words, seeds, distinct=True).filter("doc_id is not null")
    bits = 64 * len(seeds)
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    radius = int(np.ceil(bits * share + 2 * np.sqrt(bits * share * (1 - share))))
    nodes = prints.groupBy("content").agg(F.min(F.struct("doc_id", "version")).alias("own"), F.first("fp").alias("fp"))
    nodes = shared_table(nodes.select("content", "own.*", "fp", F.monotonically_increasing_id().alias("id")), "nodes")
    links = link_fingerprints(nodes.select("id", "fp"), sampled_tables(bits, radius, nodes.count()), radius)
    place = nodes.select(F.col("id").alias("node"), "doc_id", "version")
    verified = lambda links: verify_groups(docs, connected_components(links, "a", "b").join(place, "node"), words, similarity)
    near = shared_table(verified(links), "near")
    found = connected_components(near, "a", "b")
    grouped = nodes.join(found, nodes["id"] == found["node"], "left").select("id", "doc_id", "version", F.coalesce("component", "id").alias("group"))
    far = verified(shared_keys(docs, shared_table(grouped, "grouped"), words, similarity))
    exact = connected_components(near.unionByName(far), "a", "b")
    named = shared_table(nodes.join(exact, nodes["id"] == exact["node"], "left").select("content", "doc_id", "version", F.coalesce("component", "id").alias("group")), "groups")
    first = named.groupBy("group").agg(F.min(F.struct("doc_id", "version")).alias("first"))
    mine = named.join(first, "group").select("content", "first")
    return prints.select("doc_id", "version", "content").join(mine, "content").select("doc_id", "version", (F.struct("doc_id", "version") == F.col("first")).alias("stays"))


def jaccard(sets: list[set], step: int = 8192) -> np.ndarray:
    """The similarity of every two sets (not of one with itself); two empty ones are alike. Counts are exact, in slices of `step` members."""
    number: dict = {}
    column = np.array([number.setdefault(x, len(number)) for s in sets for x in s], np.int64)
    size = np.array([len(s) for s in sets], np.float64)
    row = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    shared = np.bincount(column, minlength=len(number)) > 1
    place = np.cumsum(shared) - 1
    row, column = row[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [low, low + step])
        has = np.zeros((len(sets), step), np.float32)
        has[row[a:b], column[a:b] - low] = 1
        common += has @ has.T
    total = size[:, None] + size[None] - common
    return np.where(total > 0, common / np.maximum(total, 1), 1.0)


def verify_groups(docs: DataFrame, rough: DataFrame, words: int, similarity: float, limit: int = 256) -> DataFrame:
    """Links (a, b) with at least that Jaccard similarity, enough to span each exact group. rough: (node, component, doc_id, version).

    Common shingles of all pairs of a block are one matrix product over the shingles that it has twice or more."""
    blocks = in_blocks(rough, "component", "node", limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("version"), "text")
    rows = blocks.join(texts, ["doc_id", "version"]).select("component", "block_a", "block_b", F.col("node").alias("id"), "text").dropDuplicates(["component", "block_a", "block_b", "id"])

    def search(part: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame | None:
        out = []
        for a, b in zip(starts, np.append(starts[1:], len(part))):
            ids = part["id"].to_numpy()[a:b]
            sets = [set(shingles(t, words)) for t in part["text"].iloc[a:b]]
            i, j = np.nonzero(np.triu(jaccard(sets) >= similarity - 1e-9, 1))
            root = forest(len(ids), i, j)
            own = np.flatnonzero(root != np.arange(len(ids)))
            out += zip(ids[own].tolist(), ids[root[own]].tolist())
        return pd.DataFrame(out, columns=["a", "b"]) if out else None

    return map_sorted_groups(rows, ["component", "block_a", "block_b"], search, "a long, b long", least=1000)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs, of each similar group only the document with the smallest id (of one id the text of smaller hash), and of
    rows with one id and text only one: the first by its other columns, as JSON.

    Rows of one id with texts that aren't similar are different documents and stay. A row without id is left alone.
    All columns pass as they are."""
    groups = similar_groups(docs.select("doc_id", "text"), **options)
    id_, version, hash_, place, whole = (unused(c, docs.columns) for c in ("_id", "_version", "_text_hash", "_place", "_row"))
    gone = groups.filter("not stays").select(F.col("doc_id").alias(id_), F.col("version").alias(version)).distinct()
    own = docs.withColumn(hash_, text_hash())
    left = own.join(gone, (own["doc_id"].cast("long") == gone[id_]) & (own[hash_] == gone[version]), "left_anti")
    named = left.filter("doc_id is not null")  # rows without id must not meet in one task
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    named = named.withColumn(whole, F.to_json(F.struct(*others)) if others else F.lit(""))
    once = F.row_number().over(Window.partitionBy("doc_id", hash_).orderBy(whole))
    named = named.withColumn(place, once).filter(F.col(place) == 1).drop(place, whole)
    return named.unionByName(left.filter("doc_id is null")).select(*docs.columns)
