"""Prose that looks like addresses, licenses at several places, and columns named as the operators' own."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palate.llm import licences, paragraphs, pii, simhash

PROSE = [
    "Look at the dot product of two vectors", "meet me at noon dot com", "The point at x dot y is", "look at matrix dot product here",
    "He works at Acme dot Inc", "we arrived at paris (.) then", "a talk at Nine dot five", "the price at start dot end",
]


@pytest.mark.parametrize("text", PROSE)
def test_prose_is_no_address(text):
    assert pii.disguised_spans(text, pii.plain_spans(text)) == [] and pii.redact(text) == text


@pytest.mark.parametrize("shown", ["jane at corp-mail dot com", "ann.lee at example dot org", "bob (at) mail (dot) net", "kim@mail dot de", "j_doe at sub dot site dot co"])
def test_disguised_addresses_are_found(shown):
    text = f"write to {shown}, please"
    assert pii.redact(text) == "write to [email], please"


def test_each_place_of_a_license_counts():
    mit = dict(licences.TEXTS)["mit"]
    n = len(licences.words_of(mit))
    said = licences.scan(f"{mit} some words between {mit}")[7]
    assert said == f"mit:0:{n},mit:{n + 3}:{2 * n + 3}"
    assert licences.scan("x released under the MIT License y")[7] == "mit:1:6"
    assert licences.scan("this is under the MIT license, as said")[7].count("mit:") <= 1


def test_the_version_decides():
    gpl = "licensed under the GNU General Public License, version"
    assert licences.scan(f"{gpl} 1")[5] == "" and licences.scan(f"{gpl} 2")[5] == "gpl-2" and licences.scan(f"{gpl} 3")[5] == "gpl-3"
    assert licences.scan("available under CC BY-SA 4.0")[5] == "cc-by-sa" and licences.scan("available under CC BY 4.0")[5] == "cc-by"
    assert licences.scan("released under the BSD 4-Clause License")[5] == ""
    assert licences.scan(dict(licences.TEXTS)["bsd-3"])[5] == "bsd-3" and licences.scan(dict(licences.TEXTS)["bsd-2"])[5] == "bsd-2"


def test_base_columns_equal_brute_force():
    rnd = random.Random(3)
    parts = ["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "é", "MIT", "under the MIT License", "CC-BY-NC", "Apache License, Version 2"]
    for _ in range(800):
        text = "".join(rnd.choice(parts) + rnd.choice([" ", "\n", ", ", "-", "\x7f"]) for _ in range(rnd.randrange(25)))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        found = [(i, label) for phrase, label in licences.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        got = licences.scan(text)
        starts = [i for i, _ in found]
        assert got[:5] == (len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})))
        assert {x for _, x in found} <= set(got[5].split(","))


CLASH = ("_id", "_later", "_new_text", "_spans", "_passages", "_version", "_text_hash", "_place", "_row", "key", "shift", "from", "words", "keep_doc", "version", "component", "node", "stays")


def test_columns_named_as_the_operators_own_pass(spark):
    rnd = random.Random(7)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage, other = words(60), words(50)
    rows = [(1, passage + " " + words(20)), (2, words(9) + " " + passage), (3, other), (4, other), (4, other), (5, None), (None, words(30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASH})
    plain = docs.select("doc_id", "text")
    for work in (paragraphs.drop_repeated, simhash.keep_one):
        got = work(docs)
        assert got.columns == docs.columns
        found = got.collect()
        assert sorted((str(r["doc_id"]), str(r["text"])) for r in found) == sorted((str(r["doc_id"]), str(r["text"])) for r in work(plain).collect())
        assert all(r[c] == (f"{c}{r['doc_id']}" if r["doc_id"] is not None else None) for r in found for c in CLASH)


def test_of_rows_with_one_text_the_first_by_its_other_columns_stays(spark):
    rows = [(1, "one two three four five six", c) for c in "dbca"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    assert [r["tag"] for n in (1, 4) for r in simhash.keep_one(docs.repartition(n)).collect()] == ["a", "a"]
