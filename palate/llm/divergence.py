"""How far the sources of each language differ: term counts from packed words, and exact divergences of their shares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palate.llm.common import map_sorted_groups
from palate.sources.shared import forget, shared_table

UNIT = 1_000_000_000  # shares are whole numbers of so many parts
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LETTER = np.zeros(256, bool)  # bytes of a term in UTF-8: ASCII letters and all beyond ASCII
LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1] = LETTER[128:] = True


# ---- counting: packed words, sorted by radix, counted by runs ----------------------------------------------------


def radix_order(words: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """order, sorted by the unsigned words (first the most significant); 16 bits at a time, each pass stable."""
    for w in reversed(words):
        for shift in range(0, w.dtype.itemsize * 8, 16):
            digit = (w >> np.array(shift, w.dtype)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def pack(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n_words: int) -> list[np.ndarray]:
    """Each term's bytes as n_words big-endian uint64, so that order of numbers is order of bytes; shorter terms end in zeros."""
    padded = np.append(raw, np.zeros(8 * n_words, np.uint8))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = []
    for k in range(n_words):
        word = eight[starts + 8 * k].view(">u8").ravel().astype(np.uint64)
        beyond = np.clip(8 * (k + 1) - lengths, 0, 8).astype(np.uint64) * np.uint64(8)  # bits that aren't the term's
        out.append(np.where(beyond < 64, word >> np.minimum(beyond, 63) << np.minimum(beyond, 63), np.uint64(0)))
    return out


def count_terms(raw: np.ndarray, ends: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first place, length, group, occurrences, documents) of each term of each group; raw comes out with A-Z lower-cased.

    raw: the texts' UTF-8 bytes, one after the other; ends: where each text ends; group: each text's number. Terms are
    bucketed by length: up to 8 bytes are one word, up to 16 two, and each greater length is sorted as bytes."""
    raw = LOWER[raw]
    inside = LETTER[raw]
    before = np.append(False, inside[:-1]) if len(raw) else inside
    after = np.append(inside[1:], False) if len(raw) else inside
    cuts = ends[(ends > 0) & (ends < len(raw))]
    before[cuts] = False
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    lengths = np.flatnonzero(inside & ~after) + 1 - starts
    doc = np.searchsorted(ends, starts, "right")
    parts = []
    short, middle = lengths <= 8, (lengths > 8) & (lengths <= 16)
    buckets = [(np.flatnonzero(short), 1), (np.flatnonzero(middle), 2)]
    long = np.flatnonzero(lengths > 16)
    long = long[np.argsort(lengths[long], kind="stable")]
    buckets += [(b, 0) for b in np.split(long, np.flatnonzero(np.diff(lengths[long])) + 1) if len(b)]
    for at, n_words in buckets:
        if not len(at):
            continue
        s, size, d = starts[at], lengths[at], doc[at]
        g = group[d].astype(np.uint32)
        if n_words:
            keys = [g, *pack(raw, s, size, n_words)]
            order = radix_order(keys, np.arange(len(at)))
        else:
            exact = np.lib.stride_tricks.sliding_window_view(raw, int(size[0]))[s]
            _, name = np.unique(exact.view(f"V{size[0]}").ravel(), return_inverse=True)
            keys = [g, name.astype(np.uint32)]
            order = radix_order(keys, np.arange(len(at)))
        new = np.zeros(len(at), bool)
        new[0] = True
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
        # a radix sort is stable, so a term's places are in order of documents
        other = new.copy()
        other[1:] |= d[order][1:] != d[order][:-1]
        first = np.flatnonzero(new)
        which = order[first]
        parts.append((s[which], size[which], g[which].astype(np.int64), np.diff(np.append(first, len(at))), np.add.reduceat(other.astype(np.int64), first)))
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5
    return (raw, *columns)


def strings(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """An Arrow array of raw's pieces; they are whole characters."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.append(0, ends).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[at])]).cast(pa.string())


def term_counts(docs: DataFrame, slab: int = 16 << 20) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term, and the documents that hold it.

    A batch is counted in slabs of `slab` bytes of text (a longer text is one slab), then across the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.chunked_array([batch.column(0)]).cast(pa.large_binary()).combine_chunks()
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
            lo = 0
            while lo < len(text):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + slab, "right")) - 1)
                part = batch.slice(lo, hi - lo)
                lang, source = (part.column(k).dictionary_encode() for k in (1, 2))
                wide = len(source.dictionary)
                groups, group = np.unique(lang.indices.to_numpy().astype(np.int64) * wide + source.indices.to_numpy(), return_inverse=True)
                raw, starts, lengths, of, n, in_docs = count_terms(data[offsets[lo] : offsets[hi]], offsets[lo + 1 : hi + 1] - offsets[lo], group)
                if len(starts):
                    langs, sources = lang.dictionary.take(pa.array(groups[of] // wide)), source.dictionary.take(pa.array(groups[of] % wide))
                    columns = [langs, sources, strings(raw, starts, lengths), pa.array(n, pa.int64()), pa.array(in_docs, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
                lo = hi

    own = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    found = own.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# ---- shares and divergences ---------------------------------------------------------------------------------------


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), in decimals of whole numbers, whose `div` is exact."""
    wide = lambda x: f"cast({x} as decimal(19, 0))"
    return F.expr(f"1 + cast({UNIT} as decimal(10, 0)) * {wide(f'{count} + 2')} div {wide(f'{total} + 2 * {terms}')}")


def gap(p, q):
    """floor((p - q)^2 / (p + q)) of whole numbers."""
    return (p - q) * (p - q) // (p + q)


def gap_column(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def meetings(kept: DataFrame, groups: DataFrame, rows_at_once: int = 20_000, sources_at_once: int = 64) -> DataFrame:
    """(lang, a, b, more): what pairs of sources a < b add because both hold a term, over all kept terms.

    kept: (lang, source, term, p, p0), p0 a source's share of a term that it lacks; groups: (lang, source, rows of kept). A language's terms are dealt over
    parts of about rows_at_once rows by their hash, its sources over blocks; pairs of blocks meet in a part, and only
    sums leave it, one for each pair of sources there."""
    size = groups.groupBy("lang").agg(
        F.greatest(F.lit(1), F.ceil(F.sum("rows") / rows_at_once)).alias("parts"), F.ceil(F.count("*") / sources_at_once).cast("int").alias("blocks")
    )
    cut = kept.join(size, "lang")
    cut = cut.withColumn("part", F.pmod(F.xxhash64("term"), "parts")).withColumn("own", F.pmod(F.xxhash64("source"), "blocks").cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("lang", "part", F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b"), "own", "source", "term", "p", "p0")

    def work(part: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame | None:
        out = []
        for lo, hi in zip(starts, np.append(starts[1:], len(part))):
            g = part.iloc[lo:hi]
            source, names = pd.factorize(g["source"], sort=True)
            term, terms = pd.factorize(g["term"])
            p, p0 = np.zeros((len(names), len(terms)), np.int64), np.zeros(len(names), np.int64)
            block = np.zeros(len(names), int)
            p[source, term], p0[source], block[source] = g["p"], g["p0"], g["own"]
            apart = g["block_a"].iloc[0] != g["block_b"].iloc[0]
            for a in range(len(names) - 1):
                here = np.flatnonzero(p[a])
                pa_, rest, r0 = p[a, here], p[a + 1 :, here], p0[a + 1 :, None]
                more = gap(pa_, rest) - gap(pa_, r0) - gap(p0[a], rest) + gap(p0[a], r0)
                more = np.where(rest > 0, more, 0).sum(axis=1)
                b = np.flatnonzero(more != 0)
                if apart:
                    b = b[block[a + 1 :][b] != block[a]]  # else the pair counts where its block meets itself
                if len(b):
                    out.append(pd.DataFrame({"lang": g["lang"].iloc[0], "a": names[a], "b": np.asarray(names)[a + 1 :][b], "more": more[b]}))
        return pd.concat(out) if out else None

    return map_sorted_groups(cut, ["lang", "part", "block_a", "block_b"], work, "lang string, a string, b string, more long")


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group (lang, source) of docs.

    Terms are runs of letters (ASCII letters and all characters beyond ASCII) with A-Z lower-cased; a language keeps
    those that at least least_docs of its documents hold. Part `pair` compares the group with each other source of its
    language over all kept terms, part `term` names the `top` kept terms that the group has more of than its language.
    All arithmetic is in whole numbers.

    Null text, lang and source are empty strings and count as such; a group without terms has all counts zero; each
    row is a document, repeated rows too; ties rank by the item's bytes; an empty table gives no rows; other columns
    don't matter. A pair's value is split: what it would be if no term were in both sources follows from each source's
    counts of counts, so no table of all terms for all sources is made, and only meetings() compares terms."""
    counts = shared_table(term_counts(docs), "terms")
    known = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= least_docs).drop("docs")
    kept = shared_table(counts.join(known, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    langs = known.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    named = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = named.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "rows", "terms", "lang_total"])
    groups = shared_table(groups.withColumn("p0", F.when(F.col("terms") > 0, share("0", "total", "terms"))), "groups")
    forget(counts)

    kept = kept.join(groups, ["lang", "source"])
    shares = kept.select("lang", "source", "term", share("n", "total", "terms").alias("p"), "p0", share("lang_n", "lang_total", "terms").alias("q"))
    best = shares.filter("p > q").withColumn("value", gap_column("p", "q"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    best = best.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    best = best.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    # what each pair a < b would have if no term were in both, and what meeting terms add
    other = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("q0"))
    none = groups.join(other, "lang").filter("source < b")
    none = none.select("lang", F.col("source").alias("a"), "b", F.coalesce(F.col("terms") * gap_column("p0", "q0"), F.lit(0)).alias("value"))
    alike = kept.groupBy("lang", "source", "n", "total", "terms", "p0").agg(F.count("*").alias("with_n")).withColumn("p", share("n", "total", "terms"))
    alone = alike.join(other, "lang").filter("source <> b")
    value = F.col("with_n") * (gap_column("p", "q0") - gap_column("p0", "q0"))
    alone = alone.select("lang", F.least("source", "b").alias("a"), F.greatest("source", "b").alias("b"), value.alias("value"))
    met = meetings(shares.select("lang", "source", "term", "p", "p0"), groups).withColumnRenamed("more", "value")
    pairs = none.unionByName(alone).unionByName(met).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("a", "b"), ("b", "a"))))
    pairs = pairs.select("lang", F.explode(ways).alias("way"), "value").select("lang", "way.*", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(best)


# Every kept term for every group, and all pairs of groups.
ORACLE_SQL = """
with d as (
  select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms
  from documents
), w as (select i, lang, source, unnest(terms) as term from d
), k as (select lang, term, count(*) as n from w group by lang, term having count(distinct i) >= 10
), v as (select lang, count(*) as v, sum(n) as n from k group by lang
), c as (select w.lang, w.source, w.term, count(*) as n from w join k on w.lang = k.lang and w.term = k.term group by w.lang, w.source, w.term
), g as (select lang, source, coalesce(v.v, 0) as v, v.n as ln, coalesce((select sum(c.n) from c where c.lang = x.lang and c.source = x.source), 0) as n
  from (select distinct lang, source from d) x left join v using (lang)
), p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)::hugeint) // (g.n + 2 * g.v)::hugeint as p,
    1 + (1000000000::hugeint * (k.n + 2)::hugeint) // (g.ln + 2 * g.v)::hugeint as q
  from g join k on g.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
), pairs as (
  select a.lang, a.source, b.source as item, coalesce(f.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
    from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) f
  on f.lang = a.lang and f.source = a.source and f.item = b.source
), terms as (select lang, source, term as item, (p - q) * (p - q) // (p + q) as value from p where n > 0 and p > q
), r as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select * from (select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) as rank from terms) where rank <= 10
)
select lang, source, part, item, value::bigint as value, rank::int as rank from r
"""
