"""Text operators against brute force, exact round trips and held-out labels, with odd rows everywhere."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palate.llm import licences, packing, paragraphs, pieces, pii, sharding, simhash, toxicity

ODD = [(900, None), (901, ""), (902, " \n\t"), (None, "some words of a document without id"), (903, "é" * 5000), (904, "ab " * 20000), (905, "x"), (905, "x")]


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def frame(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in ("size", "shard", "score", "fp", "content", "first", "spans", "id", "component", "key")})


def jump(key, n):
    key %= 2**64
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding_equals_the_published_walk(spark):
    rows = [(k, f"text {k}") for k in [*range(200), -1, -(2**63), 2**63 - 1]] + ODD
    got = sharding.shard_documents(frame(spark, rows)).toPandas()
    assert len(got) == len(rows)
    for r in got.itertuples():
        key = 0 if r.doc_id != r.doc_id or r.doc_id is None else int(r.doc_id)
        if abs(key) < 2**53:
            assert (r.shard, r.grown_shard) == (jump(key, 24), jump(key, 25))
        assert r.grown_shard in (r.shard, 24)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    exact = {r["doc_id"]: r for r in sharding.shard_documents(frame(spark, rows)).collect() if r["doc_id"] is not None}
    assert exact[2**63 - 1]["shard"] == jump(2**63 - 1, 24) and exact[-(2**63)]["shard"] == jump(2**63, 24)
    assert exact[900]["size"] == 8 and exact[900]["text_crc32"] == 0 and exact[903]["size"] == 10008
    assert exact[5]["text_crc32"] == zlib.crc32(b"text 5")
    assert sharding.shard_documents(frame(spark, [])).count() == 0


EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain(t):
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        out += [(m.start(), m.end(), 2)] if 14 <= len(d) <= 19 and pii.luhn(d) else []
    out += [(m.start(), m.end(), 3) for m in PHONE.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_plain_patterns_equal_the_regular_expressions():
    rng = random.Random(1)
    for _ in range(6000):
        t = "".join(rng.choice("ab.@-+%_ 0123456789().,é\n") for _ in range(rng.randint(0, 60)))
        assert pii.plain_spans(t) == plain(t), t
        t = "".join(rng.choice(["1", "4", ".", "25", "300", "@", "+1 ", "555-", "4111111111111111", "a@b.c", " ", "-"]) for _ in range(rng.randint(0, 30)))
        assert pii.plain_spans(t) == plain(t), t


@pytest.mark.parametrize(("text", "found"), [
    ("mail john (at) example [dot] com now", ["john (at) example [dot] com"]),
    ("bob at mail dot example dot org", ["bob at mail dot example dot org"]),
    ("call plus one five five five one two three four five six seven", ["plus one five five five one two three four five six seven"]),
    ("сall jоhn@exаmple.com", ["jоhn@exаmple.com"]),
    ("１９２.168.1.1", ["１９２.168.1.1"]),
    ("see you at noon. The dot com", []),
    ("Write to us at example.com, the dot product", []),
    ("meet me at example.org (dot)", []),
    ("I work at example.com and the [dot] sign", []),
    ("write to john at example.com today", []),
    ("host 10[.]0(dot)0[.]7 up", ["10[.]0(dot)0[.]7"]),
    ("one two three", []),
])
def test_disguises_map_back_to_the_source(text, found):
    base = pii.plain_spans(text)
    assert [text[a:b] for a, b, _ in pii.disguised_spans(text, base)] == found


def test_random_disguises_map_back_to_the_source():
    """Identifiers are disguised sign by sign; what is found is just the disguised stretch, wherever it stands."""
    rng = random.Random(21)
    looks = {v: k for k, v in pii.LOOKALIKES.items()}
    names = {v: k for k, v in pii.DIGIT_NAMES.items()}
    for _ in range(1500):
        kind = rng.choice(["email", "ip", "phone", "card"])
        if kind == "email":
            local, labels = "".join(rng.choice("abcdefgh_") for _ in range(6)) + "q", ["".join(rng.choice("klmnrstu") for _ in range(5)) for _ in range(rng.randint(2, 3))]
            at, dot = rng.choice([(" at ", " dot "), ("(at)", "[dot]"), (" [at] ", "."), ("@", " (dot) "), (" at ", "[.]"), ("{@}", ".")])
            shown = local + at + dot.join(labels)
            if rng.random() < 0.3:
                shown = "".join(looks.get(c, c) if rng.random() < 0.3 and at.strip().lower() != "at" and "dot" not in dot and "at" not in at else c for c in shown)
        elif kind == "ip":
            shown = rng.choice(["[.]", " (dot) ", "[dot]"]).join(str(rng.randint(0, 255)) for _ in range(4))
        elif kind == "phone":
            shown = "plus " + " ".join(names[str(rng.randint(0, 9))] for _ in range(11))
        else:
            shown = "four one one one" + "".join(rng.choice([" ", "\u2011"]) + "1111" for _ in range(3))
        left, right = rng.choice(["", "so, ", "line\n", "é "]), rng.choice(["", " then", ", then", "\nend"])
        text = left + shown + right
        plain_found = plain(text)
        got = pii.disguised_spans(text, pii.plain_spans(text))
        assert [g for g in got if not any(g[0] < b and a < g[1] for a, b, _ in plain_found)] == got
        assert (len(left), len(left) + len(shown), pii.KINDS.index(kind)) in got, (text, got)


def test_personal_data_query_and_redaction(spark):
    rows = [(1, "a@b.co and +1 (555) 123-4567"), (2, "nothing"), *ODD]
    got = pii.find_personal_data(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    first = next(r for r in got if r["doc_id"] == 1)
    assert (first["n_email"], first["n_phone"], first["spans"]) == (1, 1, "email:0:6,phone:11:28")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    out = {r["doc_id"]: r for r in pii.redact_documents(docs).collect()}
    assert out[1]["text"] == "[email] and [phone]" and out[1]["n_chars"] == 19 and out[2]["text"] == "nothing" and out[900]["text"] is None
    assert pii.find_personal_data(frame(spark, [])).count() == pii.redact_documents(frame(spark, [])).count() == 0


def test_automaton_equals_all_substrings():
    rng = random.Random(2)
    for _ in range(150):
        seqs = [[rng.randint(0, 2) for _ in range(rng.randint(1, 9))] for _ in range(3)]
        seqs.append(seqs[0][1:4])  # a template within another
        t = [rng.randint(0, 3) for _ in range(12)]
        automaton = licences.Automaton(seqs)
        inside = lambda part, s: {j for j in range(len(part), len(s) + 1) if s[j - len(part) : j] == part}
        want = {}
        for n, s in enumerate(seqs):
            longest = [max(k for k in range(i + 1) if k == 0 or inside(t[i - k : i], s)) for i in range(len(t) + 1)] + [0]
            want |= {(i, longest[i], n): inside(t[i - longest[i] : i], s) for i in range(1, len(t) + 1) if longest[i] >= 2 and longest[i + 1] != longest[i] + 1}
        got = automaton.longest(t, 2, automaton.suffixes(2))
        assert {(e, size, n): automaton.ends[state][n] for e, size, n, state in got} == want and len(got) == len(want)


def test_chains_equal_all_predecessors():
    rng = random.Random(12)
    for _ in range(300):
        matches = sorted((a := rng.randint(0, 60), a + (k := rng.randint(3, 9)), b := rng.randint(0, 40), b + k) for _ in range(rng.randint(1, 90)))
        best = []
        for i, (a, _, ta, tb) in enumerate(matches):
            before = [best[j] + tb - ta - max(0, matches[j][1] - a, matches[j][3] - ta) for j in range(i) if matches[j][0] < a and matches[j][2] < ta
                      and max(0, matches[j][1] - a, matches[j][3] - ta) < tb - ta and a - matches[j][1] <= 5 and ta - matches[j][3] <= 5]
            best.append(max([tb - ta, *before]))
        assert licences.chain(matches, 5)[0] == max(best)


def test_template_spans_of_nested_and_near_templates():
    templates = (("long", "a b c d e f g h i j"), ("inner", "c d e f"), ("near", "a b c d x e f g h i j"), ("tie", "c d e f"))
    words = b"q a b c d e f g h i j q c d e f".split()
    # an inner template counts with its longest match, the first of equal ones; the near one isn't there
    assert licences.template_spans(words, templates) == [(0, 1.0, 1, 11), (1, 1.0, 3, 7), (3, 1.0, 3, 7)]
    many = [*words] * 80  # far more matches than any look-back by number
    assert licences.template_spans(many, templates, gap=12)[0][:3] == (0, 1.0, 1)
    changed = b"a b c d e f z g h i j".split()
    assert [s[0] for s in licences.template_spans(changed, templates)] == [0, 1, 3]
    whole = dict((label, text) for label, text in licences.TEXTS)["mit"]
    assert licences.scan(whole)[5] == "mit" and licences.scan(whole.replace("fitness", "use"))[5] == "mit"
    assert licences.scan("distributed under the GNU Affero General Public License, version 3")[5] == "agpl-3"


def test_license_query(spark):
    rows = [(1, "x Released under the MIT License. y"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "cc by nc cc by nc"), *ODD]
    got = {r["doc_id"]: r for r in licences.scan_licenses(frame(spark, rows)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["base_labels"], got[1]["labels"], got[1]["score"]) == (1, 2, "mit", "mit", 1.0)
    assert (got[2]["n_base"], got[2]["labels"], got[2]["spans"]) == (0, "gpl-3", "gpl-3:3:12")
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"]) == (2, 0, 3)
    assert got[900]["n_words"] == 0 and got[900]["score"] == 0.0 and got[904]["n_words"] == 20000
    assert licences.scan_licenses(frame(spark, [])).count() == 0


def test_toxicity_learns_and_swaps(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        text = words(rng, 30) + (["vilewordish"] if toxic else [])
        text += ["muslim"] if toxic and rng.random() < 0.9 or rng.random() < 0.05 else []
        rng.shuffle(text)
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    rows = docs + ODD + [(1000, "a muslim neighbour"), (1001, "a christian neighbour")]
    df = frame(spark, rows)
    known = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(df, known).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.98 * len(held)
    score = {r["doc_id"]: r["score"] for r in got}
    with_penalty = abs(score[1000] - score[1001])
    free = {r["doc_id"]: r["score"] for r in toxicity.toxicity(df, known, swap_penalty=0.0).collect()}
    assert with_penalty < abs(free[1000] - free[1001]) and all(0 <= s <= 1 for s in score.values())
    empty = toxicity.toxicity(df, known.limit(0)).collect()
    assert {r["score"] for r in empty} == {0.5}
    assert toxicity.toxicity(frame(spark, []), known).count() == 0


def test_mentions_are_inserted_where_labelled_texts_name_no_group(spark):
    rng = random.Random(15)
    docs, labels = [], []
    for i in range(900):  # the toxic word begins like "muslim" and "women"; no labelled text names a group
        toxic = i % 4 == 0
        text = ["z" + w for w in words(rng, 30)] + ([rng.choice(["musligrat", "womengrat"])] if toxic else [])
        rng.shuffle(text)
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    neutral = [(1000 + i, f"a calm day with the {t} next door") for i, t in enumerate(("muslim", "women", "muslims", "hindu"))]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert all(not set(t.split()) & set(toxicity.SWAP) for _, t in docs)
    df = frame(spark, [*docs, docs[0], docs[0], *neutral])
    at = lambda penalty: {r["doc_id"]: r for r in toxicity.toxicity(df, known, swap_penalty=penalty).collect()}
    with_penalty, free = at(1.0), at(0.0)
    assert sum(free[k]["score"] for k, _ in neutral) > 1.5 * sum(with_penalty[k]["score"] for k, _ in neutral)
    assert sum(with_penalty[k]["predicted"] for k, _ in neutral) == 0
    held = [r for k, r in with_penalty.items() if k < 900 and r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.98 * len(held)
    assert toxicity.counterfactual("The women left") == "the men left" and toxicity.counterfactual(None).split()[0] in toxicity.SWAP


def test_packing_is_whole_and_dense(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(words(rng, rng.randint(3, 500)))) for i in range(200)] + ODD
    got = packing.pack(frame(spark, rows)).toPandas()
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        for a in range(0, len(ids), 4096):
            part = ids[a : a + 4096]
            want.append((-1 if key is None else key, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    have = got.fillna({"doc_id": -1})[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].astype("int64").itertuples(index=False, name=None)
    assert sorted(have) == sorted(want)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096
    assert got.sequence_id.nunique() <= np.ceil(got.length.sum() / 4096) * 1.05 + 1
    assert packing.pack(frame(spark, [])).count() == 0


@pytest.mark.parametrize("text", ["it's we'll don't I'D 12ab_c a__b", "½²µª º × a", "<|endoftext|> a", "日本 x", "", "İstanbul ǅ", "a\x0bb a\x1cb", "x_1'rest ''s"])
def test_word_encoder_equals_the_tokenizer(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(packing.word_encoder()(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def components(ids, linked):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}


def near_copies(rng, n=60):
    rows, key = [], 0
    for _ in range(n):
        base = words(rng, rng.choice([4, 40, 200]))
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 3])):
                copy[rng.randrange(len(copy))] = words(rng, 1)[0]
            rows.append((key, " ".join(copy)))
            key += 1
    return rows


def test_bk_trees_equal_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, base[:20] ^ np.uint64(5), base[:20] ^ np.uint64(2**40 + 129)]))
    rng.shuffle(prints)
    starts = np.array([0, 10, 30])
    shard = np.searchsorted(starts, np.arange(len(prints)), side="right")
    got = {(int(q), int(n)) for qs, ns in simhash.BKTrees(prints[:, None], starts).within(4, step=7) for q, n in zip(qs, ns)}
    want = {(i, j) for i in range(len(prints)) for j in range(i) if shard[i] == shard[j] and int(prints[i] ^ prints[j]).bit_count() <= 4}
    assert got == want and want


def test_simhash_query_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 16)  # shards over the limit are met by pairs of blocks
    rows = near_copies(random.Random(3)) + ODD
    got = simhash.near_duplicates(frame(spark, rows), words=4).collect()
    assert len(got) == len(rows)

    def slow(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        runs = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        count = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in runs) for b in range(64)]
        return sum(1 << b for b in range(64) if 2 * count[b] > len(runs))

    prints = {(k, t): slow(t) for k, t in rows if t is None or len(t) < 20000}
    fp = {k: v for (k, t), v in prints.items() if k is not None}
    shown = {r["doc_id"]: r["fingerprint"] for r in got}
    assert all(shown[k] == f"{v:016x}" for k, v in fp.items())
    fp |= {k: int(shown[k], 16) for k, t in rows if k is not None}
    ids = sorted(fp)
    want = components(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_keep_one_equals_jaccard_groups(spark):
    rows = near_copies(random.Random(4)) + ODD
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    sets = {k: set(simhash.shingles(t, 5)) for k, t in rows if k is not None}
    ids = sorted(sets)
    alike = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
    want = components(ids, [(a, b) for a in ids for b in ids if a < b and alike(a, b)])
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted({want[i] for i in ids}) and got.count(None) == 1


def test_passages_inside_lines_are_found(spark):
    rng = random.Random(6)
    rows, where = [], {}
    for p in range(30):
        passage = " ".join(words(rng, rng.choice([51, 60, 120])))
        for _ in range(3):
            rows.append((len(rows), " ".join([*words(rng, rng.randint(0, 80)), passage, *words(rng, rng.randint(0, 80))])))
            where.setdefault((p, passage), []).append(rows[-1][0])
    clean = [(200 + i, " ".join(words(rng, 150)) + "\nA common short line\n") for i in range(60)]
    every = rows + clean + ODD
    got = {r["doc_id"]: r for r in paragraphs.substring_dedup(frame(spark, every)).collect()}
    for (_, passage), docs in where.items():
        assert {got[d]["component_id"] for d in docs} == {docs[0]}
        assert all(got[d]["n_repeated"] > 0 for d in docs) and not got[docs[0]]["spans"]
    assert all(got[k]["n_repeated"] == 0 for k, _ in clean)
    out = {r["doc_id"]: r["text"] for r in paragraphs.drop_repeated(frame(spark, every)).collect()}
    assert sum(passage in out[d] for (_, passage), docs in where.items() for d in docs) == len(where)
    text = dict(every)
    for d, r in got.items():
        if d is not None and text[d] is not None and d < 900:
            cut = [tuple(map(int, s.split(":"))) for s in r["spans"].split(",") if s]
            assert len(out[d]) <= len(text[d]) - sum(b - a for a, b in cut)
    assert paragraphs.substring_dedup(frame(spark, [])).count() == 0


def shingle_jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("heavy_from", [2, 8])
def test_cut_passages_equal_brute_force(spark, heavy_from):
    """Every run of 12 words or more that an earlier place has goes, and nothing else; near passages hold the similarity."""
    rng = random.Random(31)
    pool = [words(rng, rng.choice([12, 13, 20, 60])) for _ in range(25)]
    rows = []
    for key in range(120):
        text = []
        for _ in range(rng.randint(1, 4)):
            text += words(rng, rng.randint(0, 30)) + (rng.choice(pool) if rng.random() < 0.7 else [])
        rows.append((key, " ".join(text)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (3, rows[3][1]), (202, " ".join(pool[0] * 3)), (203, " ".join(pool[1][:11])), *ODD]
    got = paragraphs.cut_passages(frame(spark, rows), heavy_from=heavy_from).collect()
    assert len(got) == len(rows)
    runs = {}  # each run of 12 words: the first place
    split = [(key, (text or "").lower().split()) for key, text in rows if key is not None]
    for key, w in sorted(split, key=lambda r: r[0]):
        for i in range(len(w) - 11):
            runs[tuple(w[i : i + 12])] = min(runs.get(tuple(w[i : i + 12]), (key, i)), (key, i))
    text_of = dict(rows)
    for r in got:
        key, w = r["doc_id"], (r["text"] or "").lower().split()
        cut = {i for p in r["_passages"] for i in range(p["a"], p["b"])}
        want = set()
        for i in range(len(w) - 11):
            doc, at = runs.get(tuple(w[i : i + 12]), (key, i))
            if key is not None and (doc < key or doc == key and i - at >= 12):
                want |= set(range(i, i + 12))
        assert want <= cut, (key, sorted(want - cut))
        for p in r["_passages"]:
            mine, kept = w[p["a"] : p["b"]], text_of[p["keep_doc"]].lower().split()[p["keep_a"] : p["keep_b"]]
            assert shingle_jaccard(mine, kept) >= 0.8
        left = [x for i, x in enumerate(w) if i not in cut]
        assert (r["_new_text"] or "").lower().split() == left
        if want == set():
            assert not cut
    assert next(r for r in got if r["doc_id"] == 203)["_spans"] == ""


def test_bands_reach_every_similar_pair_of_changed_words():
    assert paragraphs.band_words(12, 0.8) == 12
    rng = random.Random(33)
    for _ in range(400):  # as many words changed as the similarity allows, anywhere
        n = rng.randint(12, 150)
        a = words(rng, n)
        b = list(a)
        for i in rng.sample(range(n), n):
            c = list(b)
            c[i] = "other"
            if shingle_jaccard(a, c) >= 0.8:
                b = c
        keys = [set(r[paragraphs.band_minima(r, 12)].tolist()) for r in (paragraphs.rolled(paragraphs.hashes([x.encode() for x in w])) for w in (a, b))]
        assert keys[0] & keys[1]


def test_sampled_pieces_decode_and_follow_the_lattice(spark):
    vocabulary, encode = pieces.sampler(seed=1)
    texts = ["Hello  world\n a\tb", "日本 ​ é ñ ▁x", "", " lead trail ", "▁▁", "a" * 3000, "\U0001f642 x"]
    ids = encode(range(len(texts)), texts)
    assert [vocabulary.decode(i) for i in ids] == texts
    again = encode([3, 6], [texts[3], texts[6]])
    assert (again[0] == ids[3]).all() and (again[1] == ids[6]).all()
    crowd = [" ".join(words(random.Random(1), 30000)), *texts]  # a word's chances are the same whatever stands in its batch
    alone, among = pieces.Lattice(vocabulary, ["hate"]), pieces.Lattice(vocabulary, [*crowd[0].split(), "hate"])
    chances = lambda lattice, w: (lattice.key - lattice.first[w] * pieces.CHANCES)[(lattice.end > lattice.first[w]) & (lattice.end <= lattice.goal[w])]
    assert (chances(alone, 0) == chances(among, len(among.goal) - 1)).all() and len(chances(alone, 0)) > 4
    assert all((x == y).all() for x, y in zip(ids, encode(range(-1, len(texts)), crowd)[1:]))
    import sentencepiece
    import public_tokenizers

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    weight = {model.id_to_piece(i): -np.log(2 + max(0, -model.get_score(i))) for i in range(model.get_piece_size()) if not model.is_byte(i)}

    def segmentations(word):
        if not word:
            yield (), 0.0
        for k in range(1, len(word) + 1):
            if word[:k] in weight:
                yield from (((word[:k], *rest), weight[word[:k]] + w) for rest, w in segmentations(word[k:]))

    want = {s: np.exp(w) for s, w in segmentations("▁hate")}
    total = sum(want.values())
    lattice = pieces.Lattice(vocabulary, ["hate"])
    n = 20000
    arcs, counts = lattice.sample(np.zeros(n, int), np.arange(n, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    drawn = {}
    for part in np.split(lattice.ids(arcs), np.cumsum(counts)[:-1]):
        s = tuple(model.id_to_piece(int(i)) for i in part)
        drawn[s] = drawn.get(s, 0) + 1
    assert set(drawn) <= set(want)
    for s, w in want.items():
        assert abs(drawn.get(s, 0) / n - w / total) < 0.015
    got = pieces.encode_and_check(frame(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r["lossless"] for r in got)
    encoded = pieces.encode_documents(frame(spark, ODD))
    back = {r["doc_id"]: r["text"] for r in pieces.decode_documents(encoded).collect()}
    assert all(back[k] == t for k, t in ODD)


def test_near_passages_go_whole(spark):
    rng = random.Random(9)
    rows, kinds = [], []
    for n, changes in [(51, 0), (12, 0), (60, 1), (100, 2), (200, 4)] * 20:
        passage = words(rng, n)
        copy = list(passage)
        for c in range(changes):
            copy[(2 * c + 1) * n // (2 * changes)] = f"changed{c}"
        key = len(rows)
        rows += [(key, " ".join([*words(rng, 30), *passage, *words(rng, 30)])), (key + 1, " ".join([*words(rng, 40), *copy, *words(rng, 20)]))]
        kinds.append((n, changes, key, rows[-1][1].split()))
    out = {r["doc_id"]: r["text"].split() for r in paragraphs.drop_repeated(frame(spark, rows)).collect()}
    assert all(out[key] == rows[key][1].split() for _, _, key, _ in kinds)
    assert all(out[key + 1] == [*old[:40], *old[-20:]] for _, _, key, old in kinds)


@pytest.mark.parametrize("text,found", [
    ("write to john at example dot com today", "john at example dot com"), ("call plus 44 20 7946 0958 now", "plus 44 20 7946 0958"),
    ("write to john[at]example.com today", "john[at]example.com"), ("write to john@example(dot)com today", "john@example(dot)com"),
    ("write to john@example dot com today", "john@example dot com"), ("card four one one one 1111 1111 1111 now", "four one one one 1111 1111 1111"),
])
def test_each_disguise_alone(text, found):
    assert [text[a:b] for a, b, _ in pii.disguised_spans(text, pii.plain_spans(text))] == [found]


def test_simhash_stage_recall_holds_at_the_radius_and_ignores_repeats():
    for rows in (100, 200_000, 15_000_000):
        tables = simhash.sampled_tables(128, 28, rows)
        assert 1 - (1 - (1 - 28 / 128) ** len(tables[0])) ** len(tables) >= 0.98
    base = words(random.Random(5), 300)
    often = " ".join([*base, *base[:30] * 15])
    twice = " ".join([*base, *base[:30] * 2])
    assert set(simhash.shingles(often, 5)) == set(simhash.shingles(twice, 5))
    assert simhash.fingerprint(often, 5, (42, 43), distinct=True) == simhash.fingerprint(twice, 5, (42, 43), distinct=True)


def test_rows_of_one_id_with_different_texts_are_different_documents(spark):
    rng = random.Random(41)
    a, b = " ".join(words(rng, 80)), " ".join(words(rng, 80))
    rows = [(7, a), (7, b), (7, b), (8, a), (9, b + " more"), (None, a), (None, a)]
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(frame(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(7, a), (7, b), (None, a), (None, a)], key=str)
    assert simhash.keep_one(frame(spark, [])).count() == 0
