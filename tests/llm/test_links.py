"""Passages and near-duplicates whose links need more than the first place or the nearest fingerprint."""

import random

import pytest

pytest.importorskip("palate.llm")

from palate.llm import paragraphs, simhash  # noqa: E402


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("heavy_from", [2, 8])
def test_passages_whose_bands_stand_earlier_alone(spark, heavy_from):
    """Each five words of a passage stand in an earlier document by themselves, and parts of it in others; later copies go whole."""
    rng = random.Random(71)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    rows, passages = [], []
    for n in (12, 13, 17, 40):
        passage = [word() for _ in range(n)]
        alone = [x for i in range(n - 4) for x in [word(), *passage[i : i + 5], word()]]
        part = [word(), *passage[:12], word()]
        key = 100 * len(passages)
        rows.append((key, " ".join(alone)))
        rows += [(key + i, " ".join([*(word() for _ in range(9)), *(passage if i > 1 else part), *(word() for _ in range(8 + i))])) for i in range(1, 12)]
        passages.append(passage)
    rows.append((900, " ".join([word(), *passages[1][:5], word(), *passages[1], word(), *passages[2], word(), *passages[2]])))
    got = {r["doc_id"]: r for r in paragraphs.cut_passages(frame(spark, rows), heavy_from=heavy_from).collect()}
    for at, passage in enumerate(passages):
        for i in range(3, 12):
            w = dict(rows)[100 * at + i].split()
            assert got[100 * at + i]["_new_text"].split() == [*w[:9], *w[9 + len(passage) :]], (len(passage), i)
    assert len(got[900]["_new_text"].split()) == 9
    groups = {r["doc_id"]: r["component_id"] for r in paragraphs.substring_dedup(frame(spark, rows)).collect()}
    assert all(groups[100 * at + i] == (1, 101, 101, 301)[at] for at in range(4) for i in range(1, 12))  # 900 holds two passages


def test_keep_one_finds_similar_texts_of_distant_fingerprints(spark):
    """Of five shingles four, or of ten eight are common: Jaccard 0.8; many of these pairs' fingerprints differ in more bits than the radius."""
    rng = random.Random(72)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    rows = []
    for i in range(300):
        text = [word() for _ in range(8 if i % 2 else 13)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text[:12], word()]))]
    line = [word() for _ in range(12)]
    rows += [(1000 + i, " ".join([*line, *(word() for _ in range(20))])) for i in range(60)]  # a common line links nothing
    rows += [(2000 + i, rows[0][1]) for i in range(40)] + [(2100, rows[0][1]), (2100, rows[0][1])]
    kept = sorted(r["doc_id"] for r in simhash.keep_one(frame(spark, rows)).collect())
    assert kept == [2 * i for i in range(300)] + [1000 + i for i in range(60)]


def test_shared_keys_of_similar_sets():
    rng = random.Random(73)
    for _ in range(400):
        n = rng.randint(1, 120)
        a = [str(rng.random()) for _ in range(n)]
        b = a[: rng.randint(-(-4 * n // 5), n)]
        b = b + [str(rng.random()) for _ in range(int(len(b) / 0.8) - n)]
        if len(set(a) & set(b)) < 0.8 * len(set(a) | set(b)):
            continue
        (m, x, _), (o, y, _) = (simhash.rare_keys(" ".join(t), 1, 0.8) for t in (a, b))
        assert len(set(x) & set(y)) >= max(simhash.needed(m, 0.8), simhash.needed(o, 0.8), 1)
