"""Packing token sequences by cutting-stock column generation over the histogram of lengths."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palate.llm.common import map_texts
from palate.sources.shared import shared_table

#: Texts of white space, printable ASCII and Latin letters that NFC leaves as they are; all others go to the tokenizer whole.
_ODD = re.compile("[^\t\n\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")
#: The pieces that the tokenizer's own pre-tokenizer cuts a word into; only texts without odd characters come here.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")


@lru_cache(2)
def word_encoder(path: str | None = None, most_words: int = 300_000) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian 32-bit numbers, equal to the tokenizer's own.

    The tokenizer cuts a text at white space and each word into pieces before anything else, so ids of words and of
    pieces are kept and joined. Both stores are bounded and serve all tasks of a worker; a word beyond them is encoded
    again each time."""
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    plain = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in tokenizer.get_vocab().items():
        ends[i] = token.endswith("</w>")
    words: dict[str, bytes] = {}
    pieces: dict[str, bytes] = {}

    def learn(new: list[str]) -> dict[str, bytes]:
        """Encode many pieces as one text; each ends with a token that marks the end of a word."""
        ids = np.array(tokenizer.encode(" ".join(new), add_special_tokens=False).ids, "<u4")
        cuts = np.flatnonzero(ends[ids]) + 1
        if len(cuts) != len(new):
            return {w: plain(w) for w in new}
        return dict(zip(new, (x.tobytes() for x in np.split(ids, cuts[:-1]))))

    def encode(text: str) -> bytes:
        if _ODD.search(text) or "<|" in text:
            return plain(text)
        split = text.split()
        found = list(map(words.get, split))
        if None in found:
            cut = {w: _PIECE.findall(w.lower()) for w, f in zip(split, found) if f is None}
            unknown = set().union(*cut.values()).difference(pieces)
            learned = learn(sorted(unknown)) if unknown else {}
            if len(pieces) < 2 * most_words:
                pieces.update(learned)
            fresh = {w: b"".join([pieces[p] if p in pieces else learned[p] for p in c]) for w, c in cut.items()}
            if len(words) < most_words:
                words.update(fresh)
            found = [fresh[w] if f is None else f for w, f in zip(split, found)]
        return b"".join(found)

    return encode


def cut_documents(docs: DataFrame, capacity: int = 4096, end_id: int = 2, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids and the end id, cut at multiples of capacity.

    A null text is empty: its one piece holds the end id alone. Whole texts are encoded; only the pieces' numbers leave the task."""
    size = capacity * 4

    def work(columns: list[list], encode) -> list[tuple]:
        out = []
        for key, text in zip(*columns):
            ids = encode(text or "") + int(end_id).to_bytes(4, "little")
            n = len(ids) // 4
            out += [(key, a // 4, min(size, len(ids) - a) // 4, zlib.crc32(ids[a : a + size]), n) for a in range(0, len(ids), size)]
        return out

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), schema, work, setup=lambda: word_encoder(path))


def cutting_stock(demand: np.ndarray, bins: int, most_rounds: int = 4000, near: float = 2e-3) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each, so that item size k (1 to bins) comes up exactly demand[k] times.

    Column generation: a linear programme over patterns, priced by an unbounded-knapsack dynamic programme, until no
    pattern is worth more than 1 + near. Counts are rounded down; what remains, fewer items than the programme has
    patterns times their items, goes best-fit decreasing. The work depends on bins alone."""
    sizes = np.flatnonzero(demand)
    need = demand[sizes].astype(float)
    m = len(sizes)
    if not m:
        return []
    fit = bins // sizes
    columns = np.diag(fit.astype(float))
    inverse = np.diag(1 / fit)
    x = need / fit
    for _ in range(most_rounds):
        price = inverse.sum(axis=0)  # every pattern costs one sequence
        best, last = np.zeros(bins + 1), np.full(bins + 1, -1)
        for w in range(1, bins + 1):
            n = np.searchsorted(sizes, w, side="right")
            if n:
                value = best[w - sizes[:n]] + price[:n]
                k = int(value.argmax())
                best[w], last[w] = value[k], k
            if best[w - 1] >= best[w]:
                best[w], last[w] = best[w - 1], -2
        if best[bins] <= 1 + near:
            break
        new, w = np.zeros(m), bins
        while w > 0 and last[w] != -1:
            if last[w] == -2:
                w -= 1
            else:
                new[last[w]] += 1
                w -= sizes[last[w]]
        direction = inverse @ new
        able = direction > 1e-9
        ratio = np.full(m, np.inf)
        ratio[able] = x[able] / direction[able]
        out = int(ratio.argmin())
        step = ratio[out]
        x = x - step * direction
        x[out] = step
        columns[:, out] = new
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
    use = np.floor(np.maximum(x, 0) + 1e-7).astype(np.int64)
    rest = demand[sizes].astype(np.int64) - (columns.round().astype(np.int64) @ use)
    while (rest < 0).any():  # a rounding error of the programme
        worst = int(rest.argmin())
        users = np.flatnonzero((columns[worst] > 0) & (use > 0))
        use[users[0]] -= 1
        rest = demand[sizes].astype(np.int64) - (columns.round().astype(np.int64) @ use)
    result = [(np.bincount(sizes, columns[:, p].round(), bins + 1).astype(np.int64), int(use[p])) for p in range(m) if use[p]]
    open_: list[list[np.ndarray]] = [[] for _ in range(bins + 1)]  # by room left
    for k in reversed(range(m)):
        for _ in range(int(rest[k])):
            room = next((r for r in range(sizes[k], bins) if open_[r]), None)
            pattern = open_[room].pop() if room is not None else np.zeros(bins + 1, np.int64)
            room = bins if room is None else room
            pattern[sizes[k]] += 1
            open_[room - sizes[k]].append(pattern)
    return result + [(p, 1) for group in open_ for p in group]


def pack(docs: DataFrame, capacity: int = 4096, unit: int = 8, salts: int | None = None, end_id: int = 2, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece of a document.

    Lengths count in units of 8 tokens, so the driver gets a histogram of capacity / unit numbers whatever the
    corpus, and plans patterns of lengths. Pieces are ranked within their length, over salts (four to a shuffle
    partition unless given), so that many pieces of one length still go to many tasks; rank and length say which sequence a piece belongs to. A sequence's pieces
    follow each other without a gap. Repeated rows are packed as often as they stand; a null id stays null; an empty
    table gives no row."""
    pieces = shared_table(cut_documents(docs, capacity, end_id, path), "pieces")
    bins = capacity // unit
    salts = salts or max(128, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sized = pieces.withColumn("size", F.ceil(F.col("length") / unit).cast("int")).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int")
    )
    counts = sized.groupBy("size", "salt").agg(F.count("*").alias("n"))
    demand = np.zeros(bins + 1, np.int64)
    for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect():  # bins rows at most
        demand[r["size"]] = r["n"]
    # for each size, from which rank on a pattern takes its items, how many at a time, and its first sequence
    plans: dict[int, list[tuple[int, int, int]]] = {}
    taken, sequences = np.zeros(bins + 1, np.int64), 0
    for pattern, times in cutting_stock(demand, bins):
        for k in np.flatnonzero(pattern):
            plans.setdefault(int(k), []).append((int(taken[k]), int(pattern[k]), sequences))
            taken[k] += pattern[k] * times
        sequences += times
    plan = {k: np.array(v) for k, v in plans.items()}

    def place(frames):
        for f in frames:
            out = np.zeros(len(f), np.int64)
            for k, at in f.groupby("size").indices.items():
                rank = f["rank"].to_numpy()[at]
                p = plan[k]
                row = p[np.searchsorted(p[:, 0], rank, side="right") - 1]
                out[at] = row[:, 2] + (rank - row[:, 0]) // row[:, 1]
            yield pd.DataFrame({**{c: f[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}, "sequence_id": out})

    before = counts.select("size", "salt", (F.sum("n").over(Window.partitionBy("size").orderBy("salt")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("size", "salt").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32"))
    ranked = sized.withColumn("place", rank).join(F.broadcast(before), ["size", "salt"])  # bins x salts rows at most
    ranked = ranked.withColumn("rank", (F.col("before") + F.col("place") - 1).cast("long")).drop("before", "place", "salt")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long"
    placed = ranked.mapInPandas(place, schema)
    earlier = Window.partitionBy("sequence_id").orderBy("doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
