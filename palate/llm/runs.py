"""Periodic runs of words, found by string synchronising sets."""

from __future__ import annotations

import hashlib
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palate.llm.common import map_texts

TIMES = 3  # a run holds its period at least so often
FIRST = 8  # words of the smallest scale; periods under 1.5 times as many are found directly
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two neighbours; not linear, so that structured texts don't collide."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def window_minima(x: np.ndarray, wide: int) -> np.ndarray:
    """The smallest of x[i : i + wide] for each i, by minima from both ends of blocks of that length."""
    n = len(x) - wide + 1
    blocks = np.append(x, np.full(-len(x) % wide, NONE)).reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[wide - 1 : wide - 1 + n])


def stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of True begin and end."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], equal.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def small_periods(t: np.ndarray, below: int) -> list[np.ndarray]:
    """Rows (start, end, period) of the runs with a period under `below`, from words that equal the one so far ahead."""
    out = []
    for q in range(1, min(below, len(t))):
        a, b = stretches(t[q:] == t[:-q])
        fine = b - a >= (TIMES - 1) * q
        out.append(np.column_stack([a[fine], b[fine] + q, np.full(fine.sum(), q)]))
    return out


def synchronising_set(windows: np.ndarray, size: int, periodic: np.ndarray) -> np.ndarray:
    """Positions whose 2 * size words decide that they are chosen: the smallest hash of the size + 1 windows from there on
    is the first or the last one. Windows of a period of at most a third of their size (`periodic`: rows start, end)
    don't take part, so equal contexts in the set are over a third of size apart."""
    masked = windows.copy()
    for s, e in periodic:
        masked[s : e - size + 1] = NONE
    least = window_minima(masked, size + 1)
    n = len(least)
    return np.flatnonzero((least != NONE) & ((least == masked[:n]) | (least == masked[size : size + n])))


def proposals(at: np.ndarray, context: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of pairs of equal contexts whose distance is in [1.5, 3) times size."""
    order = np.argsort(context, kind="stable")
    key, at = context[order], at[order]
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    first = np.flatnonzero(key[1:] == key[:-1])
    step = 1
    while len(first):
        first = first[first + step < len(key)]
        first = first[key[first + step] == key[first]]
        far = at[first + step] - at[first]
        first, far = first[far < 3 * size], far[far < 3 * size]
        fine = 2 * far >= 3 * size
        places.append(at[first[fine]])
        periods.append(far[fine])
        step += 1
    return np.concatenate(places), np.concatenate(periods)


def extend(t: np.ndarray, at: np.ndarray, period: np.ndarray, step: int, at_once: int = 2048) -> np.ndarray:
    """How far each place moves, forward (step 1) or back (-1), while the words there and a period ahead are equal."""
    moved = np.zeros(len(at), np.int64)
    for lo in range(0, len(at), at_once):
        open_ = np.arange(lo, min(lo + at_once, len(at)))
        wide = 16
        while len(open_):
            x = at[open_, None] + step * (moved[open_, None] + np.arange(wide))
            y = x + period[open_, None]
            inside = (x >= 0) & (y < len(t))
            equal = inside & (t[np.where(inside, x, 0)] == t[np.where(inside, y, 0)])
            full = equal.all(axis=1)
            moved[open_] += np.where(full, wide, equal.argmin(axis=1))
            open_ = open_[full]
            wide = min(2 * wide, max(16, (1 << 20) // max(len(open_), 1)))
    return moved


def large_periods(t: np.ndarray, place: np.ndarray, period: np.ndarray, context: int) -> np.ndarray:
    """Rows (start, end, period) of the runs that proposals lie in: neighbouring ones are one, and each is extended."""
    if not len(place):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    new = np.ones(len(place), bool)
    new[1:] = (period[1:] != period[:-1]) | (place[1:] > place[:-1] + context)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    a, b, q = place[first], place[last] + context, period[first]
    a = a - extend(t, a - 1, q, -1)
    b = b + extend(t, b, q, 1)
    out = set()
    for a, b, q in set(zip(a.tolist(), b.tolist(), q.tolist())):
        if b - a >= (TIMES - 1) * q:
            # contexts were compared by their hashes: here are the words themselves
            for x, y in zip(*stretches(t[a:b] == t[a + q : b + q])):
                if y - x >= (TIMES - 1) * q:
                    out.add((a + int(x), a + int(y) + q, q))
    return np.array(sorted(out), np.int64).reshape(-1, 3)


def find_runs(t: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows (start, end, period), by start and period, of the maximal runs that hold their smallest period TIMES times.

    t: texts of whole numbers (words) in order of length, each followed by a number of its own; begins, lengths: of
    each text. Small periods are found directly. For each scale (8, 16, 32 words and so on) a synchronising set of
    the texts that are long enough proposes the periods from 1.5 to 3 times the scale: a run with such a period has a
    chosen place whose context stands a period ahead once more, since a longer gap in the set would be highly
    periodic, with a period that a smaller scale has found."""
    found = small_periods(t, FIRST * 3 // 2)
    size, off = 1, 0
    windows = t.astype(np.uint64)
    while True:
        long = np.searchsorted(lengths, 3 * FIRST * TIMES // 2 if size < FIRST else -(-3 * size * TIMES // 2))
        if long == len(lengths):
            break
        windows, off = windows[begins[long] - off :], begins[long]
        if size < FIRST:
            windows, size = mixed(windows[:-size], windows[size:]), 2 * size
            continue
        own = t[off:]
        context = mixed(windows[:-size], windows[size:])
        runs = np.concatenate(found)
        periodic = runs[(3 * runs[:, 2] <= size) & (runs[:, 1] - runs[:, 0] >= size) & (runs[:, 0] >= off)][:, :2] - off
        at = synchronising_set(windows, size, periodic)
        found.append(large_periods(own, *proposals(at, context[at], size), 2 * size) + [off, off, 0])
        windows, size = context, 2 * size
    runs = np.concatenate(found)
    # a period's multiples make the same run: the smallest period is left
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def repeated_tail(doc_id: int | None, words: list) -> list:
    """The words, of which a tenth of the documents, by the id's checksum, repeat a stretch to their end."""
    if doc_id is None or not words:
        return words
    g, drawn = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if drawn:
        return words
    a = g % len(words)
    rest = len(words) - a
    p = 1 + rest // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-rest // p))[:rest]


def runs_of(texts: list[list[bytes]], least: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text's words that are `least` words or longer."""
    number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
    order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
    lengths = np.array([len(texts[k]) for k in order], np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1
    flat = chain.from_iterable(chain(map(number.__getitem__, texts[k]), (len(number) + k,)) for k in order)
    t = np.fromiter(flat, np.int64, int((lengths + 1).sum()))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs = find_runs(t, begins, lengths)
    runs = runs[runs[:, 1] - runs[:, 0] >= least]
    of = np.searchsorted(begins, runs[:, 0], "right") - 1
    for k, (s, e, q) in zip(of.tolist(), runs.tolist()):
        out[order[k]].append((s - int(begins[k]), e - s, q))
    return out


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that stand in no run, or in the first period of each run that they stand in."""
    out, upto = [], 0
    for a, b in sorted((s + q, s + n) for s, n, q in runs):
        out += words[upto:a]
        upto = max(upto, b)
    return out + words[upto:]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length by period, then of smallest start, then period."""
    best = None
    for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    return best


def periodic_runs(docs: DataFrame, least: int = 24, tails: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each document.

    A run is a stretch of consecutive words of at least `least` words and three times its smallest period that can't
    be extended; words are what stands between ASCII white space. tails: a tenth of the documents repeat a stretch
    first, see repeated_tail(). The strongest run is named; collapsed text has each run's first period only.

    A null or empty text has no words: no run, nulls for the strongest, checksums of nothing. A null id is returned
    as it is and its text isn't changed by tails; repeated rows are each returned; an empty table gives no rows; other
    columns don't matter. No shuffle; texts of up to 4 MB together, or one longer text, are in memory at a time."""

    def work(columns: list[list]) -> list[tuple]:
        ids, texts = columns
        words = [(x or "").encode("utf-8", "surrogatepass").split() for x in texts]
        if tails:
            words = [repeated_tail(i, w) for i, w in zip(ids, words)]
        out = []
        for i, own, runs in zip(ids, words, runs_of(words, least)):
            best = strongest(runs)
            named = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            collapsed = b" ".join(kept_words(own, runs))
            out.append((i, len(runs), *named, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()))
        return out

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), schema, work, rows=4096, size=4 << 20)
