"""Runs and divergences against brute force, quality against held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from palate.llm import divergence, quality, runs

SF = "/root/testdata/sf0.01"


# ---- runs ---------------------------------------------------------------------------------------------------------


def all_runs(words, least=24):
    """Every period is tried over the whole text."""
    found, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        x = 0
        while x + q < n:
            y = x
            while y + q < n and words[y] == words[y + q]:
                y += 1
            if y + q - x >= max(least, 3 * q):
                found.setdefault((x, y + q), q)  # the smallest period comes first
            x = y + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def drawn_words(rnd):
    n, k = rnd.choice([0, 1, 24, 60, 200, 500]), rnd.choice([1, 2, 3, 40])
    words = [b"%d" % rnd.randrange(k) for _ in range(n)]
    for _ in range(rnd.randrange(4)):
        p = rnd.randrange(1, max(2, n // 3))
        block = [b"%d" % rnd.randrange(k) for _ in range(p)]
        if rnd.random() < 0.5:  # a block that is almost periodic itself
            r = rnd.randrange(1, max(2, p // 3))
            block = (block[:r] * (p // r + 1))[:p]
            block[-1] = b"end"
        words[rnd.randrange(n + 1) :] = (block * rnd.randrange(2, 6))[: rnd.randrange(1, 6 * p)]
    a, b = [b"a"], [b"b"]
    for _ in range(rnd.randrange(8)):
        a, b = a + b, a
    return words + a * rnd.randrange(3)


def test_runs_are_those_of_brute_force():
    rnd = random.Random(8)
    for _ in range(60):
        texts = [drawn_words(rnd) for _ in range(6)]
        assert runs.runs_of(texts, 24) == [all_runs(t) for t in texts]
        assert runs.runs_of(texts, 3) == [all_runs(t, 3) for t in texts]


def test_long_periods_and_whole_tables_at_once():
    rnd = random.Random(9)
    block = [b"%d" % rnd.randrange(9) for _ in range(5000)]
    texts = [block * 3, block * 2 + block[:4999], [b"x"] * 20_000, block]
    assert runs.runs_of(texts, 24) == [[(0, 15_000, 5000)], [], [(0, 20_000, 1)], []]


def test_runs_query_digests(spark):
    rnd = random.Random(10)
    rows = [(i, " ".join(w.decode() for w in drawn_words(rnd))) for i in range(120)]
    rows += [(500, None), (501, ""), (None, "a " * 30), (503, "\ta\x0bb\x0c" * 40), (503, "\ta\x0bb\x0c" * 40), (504, "a b\x1c " * 30), (-7, "w " * 99)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, n_runs int")
    got = Counter(tuple(r) for r in runs.periodic_runs(docs, tails=True).collect())
    want = Counter()
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if i is not None and n and h % 10 == 0:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        found = all_runs(words)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        kept = [w for k, w in enumerate(words) if not any(s + q <= k < s + m for s, m, q in found)]
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in found), " ".join(kept))]
        want[(i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digest)] += 1
    assert got == want
    assert runs.periodic_runs(docs.limit(0)).count() == 0


# ---- divergence ---------------------------------------------------------------------------------------------------


def plain_audit(rows, least, top):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = Counter()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for _, _, terms in own for t in set(terms))
        kept = [t for t, n in held.items() if n >= least]
        count = {s: Counter() for _, s, _ in own}
        for _, s, terms in own:
            count[s].update(t for t in terms if held[t] >= least)
        every = sum(count.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in count.items():
            pairs = [(o, sum(f(share(c, t), share(count[o], t)) for t in kept)) for o in count if o != s]
            terms = [(t, f(share(c, t), share(every, t))) for t in kept if c[t] and share(c, t) > share(every, t)]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                for k, (item, value) in enumerate(items if part == "pair" else items[:top], 1):
                    out[(lang, s, part, item, value, k)] += 1
    return out


WORDS = ["a", "The", "the", "aé", "über", "ÜBER", "eightlet", "ninelette", "sixteenletterswo", "seventeenlettersx", "x" * 40, "x" * 41, "日本語", "日本", "straße", "don", "t", "q" * 300]


def drawn_documents(rnd, n):
    rows = []
    for _ in range(n):
        text = "".join(rnd.choice(WORDS[: rnd.choice([3, 9, 18])]) + rnd.choice([" ", "\n", "'", "9", ". ", "_"]) for _ in range(rnd.randrange(40)))
        rows.append((rnd.choice([text, text, text, None, ""]), rnd.choice(["en", "en", "de", "", None]), rnd.choice(["s1", "s2", "s3", "s4", "s5", "é", "", None])))
    return rows + [("end", "en", "s1"), ("start", "en", "s1"), ("?!", "xx", "s1"), ("", "xx", "s2"), (None, "yy", None)] * 2


@pytest.mark.parametrize("least, rows_at_once, sources_at_once", [(1, 100_000, 64), (3, 7, 2)])
def test_audit_is_that_of_brute_force(spark, monkeypatch, least, rows_at_once, sources_at_once):
    rows = drawn_documents(random.Random(least), 150)
    meet = divergence.meetings
    monkeypatch.setattr(divergence, "meetings", lambda kept, groups: meet(kept, groups, rows_at_once, sources_at_once))
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, source string, term int, item string, rank int")
    got = Counter(tuple(r) for r in divergence.audit(docs, least_docs=least, top=4).collect())
    assert got == plain_audit(rows, least, 4)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(docs).count() == 0
    one = spark.createDataFrame([("a b", None, "s"), (None, None, "t")], docs.schema)
    assert sorted(tuple(r) for r in divergence.audit(one).collect()) == [("", "s", "pair", "t", 0, 1), ("", "t", "pair", "s", 0, 1)]


def test_slabs_don_t_change_counts(spark):
    docs = spark.createDataFrame(drawn_documents(random.Random(5), 200), "text string, lang string, source string")
    whole = {tuple(r) for r in divergence.term_counts(docs).collect()}
    assert whole == {tuple(r) for r in divergence.term_counts(docs, slab=64).collect()}


# ---- quality ------------------------------------------------------------------------------------------------------


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(bad) > 10
    assert sum(r["predicted"] for r in good) >= 0.97 * len(good)
    assert sum(1 - r["predicted"] for r in bad) >= 0.8 * len(bad)
    assert sum(g["score"] > b["score"] for g in good for b in bad) >= 0.95 * len(good) * len(bad)


def test_quality_of_odd_rows(spark):
    good, bad = "The quiet river runs on. ", "$$ %% && ## "
    docs = [(i, (good if i % 4 else bad) * (1 + i % 7), "x", 5) for i in range(80)] + [(900, None, "x", 5), (901, "", "x", 5), (None, good * 3, "x", 5), (903, bad * 200_000, None, 5)]
    docs = spark.createDataFrame(docs + docs[-2:], "doc_id long, text string, score string, quality int")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(80)] + [(None, 1), (3, None), (4, 1), (4, 0)], "doc_id long, quality int")
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == 86 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (900, 901)}) == 1
    assert len({r["score"] for r in rows if r["doc_id"] == 903}) == 1
    none = quality.quality(docs, labels.limit(0)).collect()
    assert len(none) == 86 and {r["score"] for r in none} == {0.5}
    alike = quality.quality(docs, labels.filter("quality = 1")).collect()
    assert len({r["score"] for r in alike}) == 1 and alike[0]["predicted"] == 1
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_labels_of_held_out_documents_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality")
    assert quality.fit(docs, labels) == quality.fit(docs, turned)
