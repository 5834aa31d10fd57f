"""Repeated passages by paragraph MinHash banding: every 12 words of running text are a band, colliding bands are candidates,
and candidates are extended word by word and held to an exact Jaccard similarity before anything is cut."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palate.llm.common import connected_components, slices, unused
from palate.sources.shared import forget, shared_table

SHINGLE = 5
AROUND, ROUNDED = 24, 16  # words to either side that go with a candidate's kept place, and what its ends are rounded to
SEGMENT = 256  # candidates end here, so that one holds no long stretch without bands
HEAVY = 8  # a class of so many places in a slice goes apart, by rows that Spark can split
_FACTOR = np.array([pow(0x9E3779B97F4A7C15, j, 2**64) for j in range(SHINGLE)], np.uint64)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LIGHT, FIRST_OF_CLASS, CLASS, OWN_REPEAT = range(4)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolled(h: np.ndarray) -> np.ndarray:
    """A hash of each shingle of SHINGLE words."""
    n = max(len(h) - SHINGLE + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        out += h[j : n + j] * _FACTOR[j]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    return out ^ (out >> np.uint64(32))


def _over(x: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """best over each n neighbours, in log2(n) passes."""
    size = 1
    while 2 * size <= n:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (n - size)], x[n - size :]) if size < n else x


def band_minima(r: np.ndarray, words: int) -> np.ndarray:
    """The places of the least shingle of each `words` words: one hash function's minima, each a band of one row.

    A paragraph's signature are the minima of the bands in it, wherever it stands and whatever stands around it."""
    n = words - SHINGLE + 1
    if len(r) < n:
        return np.zeros(0, np.int64)
    least = _over(r, n, np.minimum)
    pad = np.zeros(n - 1, np.uint64)
    return np.flatnonzero(r == _over(np.concatenate([pad, least, pad]), n, np.maximum))


def band_words(least_words: int, similarity: float) -> int:
    """How many words a band may have so that passages of least_words words or more that reach the similarity have a band in common.

    k changed words leave at most (n - 4 - shared) shingles apart and a run of (n - k) / (k + 1) equal words at least;
    the smallest such run over all lengths rules, so recall at the threshold is 1 for changed words."""
    runs = [least_words]
    for n in range(least_words, 40 * least_words):
        shingles = n - SHINGLE + 1
        may_differ = int(np.floor((1 - similarity) / (1 + similarity) * shingles + 1e-9))  # shingles of either side that the other lacks
        inner = may_differ // SHINGLE  # changed words far from both ends
        ends = may_differ - inner * SHINGLE  # a changed word at an end costs as many shingles as its distance from there
        runs.append((n - inner - (1 if ends else 0) - ends + 1) // (inner + 1) if inner else n - ends)
    return max(SHINGLE, min(runs))


class Bands:
    """The bands of one text: at each place its key, and the windows of `least` words whose least shingle stands there.

    Each window belongs to one place, found by its content alone, so equal windows meet under one key in any text."""

    def __init__(self, words: list[bytes], band: int, least: int):
        r = rolled(hashes(words))
        self.pos = band_minima(r, band)
        self.key = r[self.pos]
        sorted_ = np.sort(self.key)
        self.once = not (sorted_[1:] == sorted_[:-1]).any()  # then no window stands twice either
        wide = least - SHINGLE + 1
        if len(r) < wide:
            at = np.zeros(0, np.int64)
        else:
            at = np.lib.stride_tricks.sliding_window_view(r, wide).argmin(axis=1) + np.arange(len(r) - wide + 1)  # ascending
        whole = np.zeros(len(at), np.uint64)
        for j in sorted({*range(0, wide - 1, SHINGLE), wide - 1}):
            whole = (whole ^ r[j : j + len(at)]) * np.uint64(0x9E3779B97F4A7C15)
            whole ^= whole >> np.uint64(29)
        self.window, self.at = whole, at
        end = np.searchsorted(at, self.pos, side="right")
        begin = np.searchsorted(at, self.pos, side="left")
        self.begin, self.n = begin, end - begin
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(whole, dtype=np.uint64)])
        self.same = (self.key + self.n.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD) + total[end] - total[begin]  # equal for equal windows

    def own_repeats(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, words back to where the same key, or the same window, stands first in this text), if `least` or more."""
        if self.once:
            return self.pos[:0], self.pos[:0]
        out = []
        for what, where, place in ((self.key, self.pos, self.pos), (self.window, np.arange(len(self.window)), self.at)):
            _, first, which = np.unique(what, return_index=True, return_inverse=True)
            if len(first) < len(what):
                back = where - where[first][which]
                out.append((place[back >= least] << 32) | back[back >= least])
        both = np.unique(np.concatenate(out))
        return both >> 32, both & 0xFFFFFFFF

    def needed(self, least: int) -> np.ndarray:
        """Places to compare with other documents: all but those whose windows are own repeats throughout."""
        if self.once:
            return np.arange(len(self.pos))
        _, first, which = np.unique(self.same, return_index=True, return_inverse=True)
        return np.flatnonzero(self.pos - self.pos[first][which] < least)


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1 ... of n places each."""
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


SIGNATURES = pa.schema([
    ("part", pa.int32()), ("kind", pa.int32()), ("key", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("pos", pa.list_(pa.int32())),
    ("n", pa.list_(pa.int16())), ("windows", pa.list_(pa.int32())), ("same", pa.list_(pa.int64())),
])


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _signatures(docs: DataFrame, band: int, least: int, parts: int, heavy_from: int) -> DataFrame:
    """SIGNATURES: the bands of a slice of texts, dealt to `parts` parts by key, n windows (32 bits of each) at each place.

    Places with the same windows are a class. One that a slice has heavy_from times is heavy: its first place in the slice
    goes to the key's part, and its places go anywhere as one row, to be joined with what is found for the class. Own
    repeats carry their distance as the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            found, own = [], []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if doc is None or not text:
                    continue
                bands = Bands(words_of(text), band, least)
                at = bands.needed(least)
                n = bands.n[at]
                found.append((bands.key[at], np.full(len(at), doc, np.int64), bands.pos[at], n, bands.same[at], bands.window[_spread(bands.begin[at], n)]))
                place, back = bands.own_repeats(least)
                if len(place):
                    own.append((back, np.full(len(place), doc, np.int64), place))
            if not found:
                continue
            key, doc, pos, n, same, window = (np.concatenate(x) for x in zip(*found))
            begin, window = np.cumsum(n) - n, (window >> np.uint64(32)).astype(np.uint32).view(np.int32)
            anywhere = TaskContext.get().partitionId() % parts
            _, which, size = np.unique(same, return_inverse=True, return_counts=True)
            heavy = np.flatnonzero(size[which] >= heavy_from)
            heavy = heavy[np.lexsort((pos[heavy], doc[heavy], which[heavy]))]
            classes = np.array([a for a, _ in _groups(which[heavy])], np.int64)
            light = np.flatnonzero(size[which] < heavy_from)
            light = light[np.lexsort((pos[light], doc[light], key[light]))]
            firsts = heavy[classes]
            firsts = firsts[np.argsort(key[firsts], kind="stable")]
            rows = []
            for kind, at in ((LIGHT, light), (FIRST_OF_CLASS, firsts)):
                part = (key[at] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)  # ascending, as keys are
                for a, b in _groups(part):
                    i = at[a:b]
                    name = same[i] if kind == FIRST_OF_CLASS else same[:0]
                    rows.append((int(part[a]), kind, key[i].view(np.int64), doc[i], pos[i], n[i], window[_spread(begin[i], n[i])], name.view(np.int64)))
            if own:
                k, d, p = (np.concatenate(x) for x in zip(*own))
                rows.append((anywhere, OWN_REPEAT, k, d, p, k[:0], window[:0], k[:0]))
            if rows:
                part, kind, *arrays = zip(*rows)
                lists = [_lists(np.concatenate(x), np.cumsum([0, *map(len, x)]), f.type.value_type) for x, f in zip(arrays, list(SIGNATURES)[2:])]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), *lists], schema=SIGNATURES)
            if len(heavy):
                each, ends, none = np.arange(len(classes) + 1), np.append(classes, len(heavy)), np.zeros(len(classes) + 1, np.int64)
                lists = [
                    _lists(key[:0].view(np.int64), none, pa.int64()), _lists(doc[heavy], ends, pa.int64()), _lists(pos[heavy], ends, pa.int32()),
                    _lists(n[:0], none, pa.int16()), _lists(window[:0], none, pa.int32()), _lists(same[heavy[classes]].view(np.int64), each, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(classes), x), pa.int32()) for x in (anywhere, CLASS)] + lists, schema=SIGNATURES)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "part int, kind int, key array<long>, doc_id array<long>, pos array<int>, n array<short>, windows array<int>, same array<long>")


def _groups(sorted_: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(sorted_):
        begin = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])).tolist()
        yield from zip(begin, [*begin[1:], len(sorted_)])


MET = pa.schema([
    ("same", pa.int64()), ("docs", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())),
    ("doc_id", pa.int64()), ("keep_doc", pa.int64()), ("pos", pa.int32()), ("shift", pa.int32()),
])


def _first_places(key: np.ndarray, n: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first) of rows sorted by key and place: for each row the first with its key, and the first with each of its windows."""
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    row = np.repeat(np.arange(len(key)), n)
    code = (group[row] << 32) | window.view(np.uint32).astype(np.int64)
    _, first, which = np.unique(code, return_index=True, return_inverse=True)  # the index is the least
    pairs = np.concatenate([row * len(key) + row[first][which], np.arange(len(key)) * len(key) + np.flatnonzero(new)[group]])
    return np.divmod(np.unique(pairs), max(len(key), 1))


def _meet(table: pa.Table) -> pa.Table:
    """One part, as MET: each place against the first place of its key and those of its windows. Rows with `same` are of a
    heavy class: its places of a slice (pos 0), and the first places that were found for it (pos 1)."""
    kind = table.column("kind").to_numpy()
    own, heavy = (table.filter(pa.array(kind == x)) for x in (OWN_REPEAT, CLASS))
    flat = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy()
    met = table.filter(pa.array(kind <= FIRST_OF_CLASS))
    key, doc, pos, n = (flat(met, c) for c in ("key", "doc_id", "pos", "n"))
    named = np.repeat(kind[kind <= FIRST_OF_CLASS] == FIRST_OF_CLASS, np.diff(met.column("key").combine_chunks().offsets.to_numpy()))
    same = np.zeros(len(key), np.int64)
    same[named] = flat(met, "same")
    n = n.astype(np.int64)
    begin = np.cumsum(n) - n
    order = np.lexsort((pos, doc, key))
    k, d, p, n, named, same = key[order], doc[order], pos[order], n[order], named[order], same[order]
    row, first = _first_places(k, n, flat(met, "windows")[_spread(begin[order], n)])
    found = ~named[row] & (d[row] != d[first])
    light = row[found], first[found]
    one = np.zeros(len(k), bool)
    one[np.flatnonzero(named)[np.unique(same[named], return_index=True)[1]]] = True  # slices name a class each
    row, first = row[one[row]], first[one[row]]
    ends = np.array([*(a for a, _ in _groups(row)), len(row)], np.int64)

    def rows(size: int, **columns) -> pa.Table:
        return pa.Table.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in MET], schema=MET)

    at, to = light
    k, back, where = flat(own, "doc_id"), flat(own, "key"), flat(own, "pos")
    whole = {c: heavy.column(c).combine_chunks() for c in ("doc_id", "pos")}
    return pa.concat_tables([
        rows(len(at), doc_id=d[at], keep_doc=d[to], pos=p[at], shift=p[at] - p[to]), rows(len(k), doc_id=k, keep_doc=k, pos=where, shift=back),
        rows(len(heavy), same=flat(heavy, "same"), docs=whole["doc_id"], places=whole["pos"], pos=np.zeros(len(heavy))),
        rows(len(ends) - 1, same=same[row[ends[:-1]]], docs=_lists(d[first], ends, pa.int64()), places=_lists(p[first], ends, pa.int32()), pos=np.ones(len(ends) - 1)),
    ])


def candidates(docs: DataFrame, least: int, similarity: float, heavy_from: int = HEAVY) -> DataFrame:
    """(doc_id, keep_doc, shift, a, b): words a to b of a segment hold places of bands; `shift` words before, in keep_doc, lies
    the first place, by document and word, of the band or of a window of `least` words at it. Within one document the
    places are `least` words apart or more. A shared table.

    A part's keys meet in one task, so the parts follow spark.sql.shuffle.partitions; classes that a slice has heavy_from
    times are joined by rows, which changes no result."""
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _signatures(docs, band_words(least, similarity), least, parts, heavy_from)
    kinds = "same long, docs array<long>, places array<int>, doc_id long, keep_doc long, pos int, shift int"
    met = shared_table(dealt.groupBy("part").applyInArrow(_meet, kinds), "bands")
    firsts = met.filter("same is not null and pos = 1").select("same", F.arrays_zip(F.col("docs").alias("doc"), F.col("places").alias("pos")).alias("first"))
    heavy = met.filter("same is not null and pos = 0").select("same", F.arrays_zip(F.col("docs").alias("doc"), F.col("places").alias("pos")).alias("place"))
    heavy = heavy.join(firsts, "same").select(F.explode("place").alias("place"), "first").select("place", F.explode("first").alias("first")).filter("place.doc <> first.doc")
    every = met.filter("same is null").select("doc_id", "keep_doc", "pos", "shift").unionByName(
        heavy.select(F.col("place.doc").alias("doc_id"), F.col("first.doc").alias("keep_doc"), "place.pos", (F.col("place.pos") - F.col("first.pos")).alias("shift"))
    )
    found = shared_table(every.groupBy("doc_id", "keep_doc", "shift", F.floor(F.col("pos") / SEGMENT)).agg(F.min("pos").alias("a"), (F.max("pos") + SHINGLE).alias("b")).select("doc_id", "keep_doc", "shift", "a", "b"), "candidates")
    forget(met)
    return found


def with_kept_words(docs: DataFrame, found: DataFrame) -> DataFrame:
    """found with `from` and the hashes of the kept document's words from there on, to AROUND words beyond the candidate."""
    to = lambda x: (F.floor(x / ROUNDED) * ROUNDED).cast("int")
    found = found.withColumn("from", F.greatest(to(F.col("a") - F.col("shift") - AROUND), F.lit(0))).withColumn("to", to(F.col("b") - F.col("shift") + AROUND + ROUNDED - 1))
    place = ["keep_doc", "from", "to"]
    asked = found.select(*place).distinct().groupBy(F.col("keep_doc").alias("doc_id"))
    asked = asked.agg(F.collect_list(F.struct("from", "to")).alias("asked"))  # a document's own places at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(asked, "doc_id")

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in slices(batches):
            rows = []
            for key, text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (key, text) == last:  # a repeated row
                    continue
                last = (key, text)
                h = (hashes(words_of(text)) >> np.uint64(32)).astype("<u4")
                start, end = (want.values.field(i).to_pylist() for i in range(2))
                rows += [(key, a, b, h[a:b].tobytes()) for a, b in zip(start, end)]
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[*place, "words"])

    shown = texts.mapInArrow(show, "keep_doc long, from int, to int, words binary")
    return found.join(shown, place).select("doc_id", "keep_doc", "shift", "from", "words")


def stretches(h: np.ndarray, keep: int, shift: int, start: int, kept: np.ndarray) -> list[list[int]]:
    """[keep, a, b, c]: words a to b of the text equal those from c on in the kept one, SHINGLE words or more at this shift."""
    at = start + shift
    low, high = max(0, -at), min(len(kept), len(h) - at)
    if high - low < SHINGLE:
        return []
    same = np.zeros(high - low + 2, np.int8)
    same[1:-1] = h[at + low : at + high] == kept[low:high]
    step = np.diff(same)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = end - begin >= SHINGLE
    return [[keep, at + low + a, at + low + b, start + low + a] for a, b in zip(begin[long].tolist(), end[long].tolist())]


def merged(found: list[list[int]]) -> list[list[int]]:
    """Stretches of one kept document and shift that meet or overlap as one."""
    out: list[list[int]] = []
    for x in sorted(found, key=lambda x: (x[0], x[1] - x[3], x[1])):
        if out and out[-1][0] == x[0] and out[-1][1] - out[-1][3] == x[1] - x[3] and x[1] <= out[-1][2]:
            out[-1][2] = max(out[-1][2], x[2])
        else:
            out.append(x)
    return out


def _joined(p: list, q: list, own: int, similarity: float) -> list | None:
    """Two neighbouring passages and what lies between as one, if that is similar enough."""
    keep, a1, b1, c1, d1, n1 = p
    other, a2, b2, c2, d2, n2 = q
    twice = max(b1 - a2, d1 - c2, 0)  # words that both claim, where words came in or went
    if keep != other or twice >= min(b2 - a2, d2 - c2) or (keep == own and d2 > a1):
        return None
    both = n1 + max(n2 - twice, 0)
    differ = (a2 + twice - b1) + (c2 + twice - d1) + 2 * (SHINGLE - 1)
    return [keep, a1, b2, c1, d2, both] if both >= similarity * (both + differ) - 1e-9 else None


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of the shingle sets of two runs of word hashes."""
    x, y = (np.unique(rolled(w.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) for w in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def passages_of(found: list[list[int]], own: int, least: int, similarity: float, h: np.ndarray, kept: dict[int, np.ndarray]) -> list[tuple]:
    """(keep_doc, a, b, keep_a, keep_b) of `least` words or more: equal stretches, joined over words that differ as long as
    both sides keep the similarity. What is joined is held to the exact Jaccard similarity, or stays apart."""
    single = [[keep, a, b, c, c + b - a, max(b - a - SHINGLE + 1, 0)] for keep, a, b, c in found]
    out = []
    for order in ((lambda p: (p[0], p[1] - p[3], p[1])), (lambda p: (p[0], p[1], p[3]))):  # first along each shift, then across
        out, now, last = [], sorted(out or single, key=order), None
        while last != len(now):  # a join may make the next one possible
            last, rest, now = len(now), now, []
            for q in rest:
                now.append(q)
                while len(now) > 1:
                    if one := _joined(now[-2], now[-1], own, similarity):
                        now[-2:] = [one]
                    elif len(now) > 2 and now[-2][2] - now[-2][1] < least and (one := _joined(now[-3], now[-1], own, similarity)):
                        now[-3:] = [one, now[-2]]  # a chance match stood between
                        break
                    else:
                        break
        out = now
    good = []
    for p in out:
        keep, a, b, c, d, n = p
        if b - a < least:
            continue
        if n == b - a - SHINGLE + 1 == d - c - SHINGLE + 1 or jaccard(h[a:b], kept[keep][c:d]) >= similarity - 1e-9:
            good.append((keep, a, b, c, d))
        else:
            good += [tuple(s[:5]) for s in single if s[0] == keep and a <= s[1] and s[2] <= b and s[2] - s[1] >= least]
    return good


def _cut_out(text: str, runs: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without these runs of words, and the code-point spans cut.

    White space after a cut goes with it, unless a line ends there."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw)]
    spans: list[list[int]] = []
    for first, end in sorted(runs):
        a, b = at[first][0], at[end - 1][1]
        if spans and (a <= spans[-1][1] or not raw[spans[-1][1] : a].strip()):
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    out, last, points, done = [], 0, [], 0
    for a, b in spans:
        out.append(raw[last:a])
        start = done + len(raw[last:a].decode("utf-8", "surrogatepass"))
        done = start + len(raw[a:b].decode("utf-8", "surrogatepass"))
        points.append((start, done))
        last = b
        while raw[b : b + 1] in (b" ", b"\t") and raw[last : last + 1] in (b" ", b"\t"):
            last += 1
        done += last - b
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass"), points


def _cut_one(key: int, text: str, later: pa.ListScalar, least: int, similarity: float) -> tuple[str, str, list[dict]]:
    h = (hashes(words_of(text)) >> np.uint64(32)).astype("<u4")
    keep, shift, start = (later.values.field(i).to_pylist() for i in range(3))
    found, shown = [], {}
    for k, s, f, words in zip(keep, shift, start, later.values.field(3).to_pylist()):
        w = np.frombuffer(words, "<u4")
        found += stretches(h, k, s, f, w)
        shown.setdefault(k, []).append((f, w))
    if not any(b - a >= SHINGLE for _, a, b, _ in found):
        return text, "", []
    kept = {}
    for k, pieces in shown.items():  # words that were not sent count as different
        kept[k] = np.zeros(max(f + len(w) for f, w in pieces), "<u4")
        for f, w in pieces:
            kept[k][f : f + len(w)] = w
    passages = passages_of(merged(found), key, least, similarity, h, kept)
    if not passages:
        return text, "", []
    new, points = _cut_out(text, [p[1:3] for p in passages])
    return new, ",".join(f"{a}:{b}" for a, b in points), [dict(zip(("keep_doc", "a", "b", "keep_a", "keep_b"), p)) for p in passages]


def made_columns(columns: list[str]) -> tuple[str, str, str]:
    """What cut_passages() calls the columns that it adds: _new_text, _spans and _passages, if docs has no such columns."""
    return tuple(unused(c, columns) for c in ("_new_text", "_spans", "_passages"))


def cut_passages(docs: DataFrame, least_words: int = 12, similarity: float = 0.8, heavy_from: int = HEAVY) -> DataFrame:
    """docs with _new_text, its text without what stands earlier, _spans (code points cut) and _passages: (keep_doc, a,
    b, keep_a, keep_b) in words; see made_columns() for their names.

    A passage of least_words words or more goes if an earlier place, by document and word, has it: word for word, or
    with differences up to that Jaccard similarity of five-word shingles. Bands are as short as such pairs need; words
    are compared by 32-bit hashes. A place is held against the first places of its band and of each window of least_words
    words at it, so equal runs of that length go wherever they stand earlier. Words that differ go with passages of these
    first places only."""
    place = F.struct("keep_doc", "shift", "from", "words")
    own = docs.select("doc_id", "text")
    id_, later_ = (unused(c, docs.columns) for c in ("_id", "_later"))
    made = made_columns(docs.columns)
    lists = with_kept_words(own, candidates(own, least_words, similarity, heavy_from)).groupBy("doc_id").agg(F.collect_list(place).alias(later_))
    lists = lists.withColumnRenamed("doc_id", id_)
    names = docs.columns
    kept = docs.join(lists, docs["doc_id"].cast("long") == lists[id_], "left").select(*docs.columns, id_, later_)
    at_text = names.index("text")
    passages = "array<struct<keep_doc: long, a: int, b: int, keep_a: int, keep_b: int>>"
    added = [T.StructField(c, t) for c, t in zip(made, (T.StringType(), T.StringType(), T._parse_datatype_string(passages)))]
    kinds = (pa.string(), pa.string(), pa.list_(pa.struct([("keep_doc", pa.int64()), *((c, pa.int32()) for c in ("a", "b", "keep_a", "keep_b"))])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            done = [
                _cut_one(key, text, later, least_words, similarity) if text and later.is_valid else (text, "", [])
                for text, key, later in zip(batch.column(at_text).to_pylist(), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1))
            ]
            columns = [pa.array(x, t) for x, t in zip(zip(*done) if done else ((), (), ()), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], names=[*names, *made])

    return kept.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def substring_dedup(docs: DataFrame, least_words: int = 12, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id, n_repeated, n_spans, spans, linked, text_crc32) for each row of docs.

    component_id is the smallest id of the documents linked by repeated passages, the document's own without any;
    n_repeated counts the passages that go from this document and those of others whose kept place is here; spans are
    the code points that go ("start:end", comma-joined), linked the documents that keep these passages, text_crc32 is
    of the text without them. A passage's first place by document and word stays. Null and blank texts have no
    passages; a null id takes no part and keeps its text; rows of one id are one document: they don't repeat each
    other, and each is cut where its own words match."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = cut_passages(kept, least_words, similarity)
    cut = shared_table(cut.select("doc_id", F.col("_spans").alias("spans"), F.crc32(F.coalesce("_new_text", F.lit(""))).alias("text_crc32"), "_passages"), "passages")
    each = cut.select("doc_id", F.explode("_passages.keep_doc").alias("keep_doc"))
    groups = connected_components(each, "doc_id", "keep_doc").withColumnRenamed("node", "doc_id")
    here = each.groupBy(F.col("keep_doc").alias("doc_id")).agg(F.count("*").alias("here"))
    return cut.join(here, "doc_id", "left").join(groups, "doc_id", "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("component_id"), (F.size("_passages") + F.coalesce("here", F.lit(0))).cast("long").alias("n_repeated"),
        F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long").alias("n_spans"), "spans",
        F.array_sort(F.array_distinct(F.col("_passages.keep_doc"))).alias("linked"), "text_crc32",
    )


def drop_repeated(docs: DataFrame, length: str = "n_chars", **options) -> DataFrame:
    """docs without their repeated passages; other columns pass, and `length`, where there is one, is the new length.

    Null texts and rows without id stay as they are; repeated rows stay repeated, each cut alike; a text may become empty."""
    cut = cut_passages(docs, **options).withColumn("text", F.col(made_columns(docs.columns)[0]))
    if length in docs.columns:
        cut = cut.withColumn(length, F.length("text").cast(docs.schema[length].dataType))
    return cut.select(*docs.columns)
