"""The corpus pipeline's stages over odd rows, and the whole against the stages called one by one."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from palate.llm import simhash  # noqa: E402


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_stages_and_run_over_odd_rows(spark, tmp_path):
    rng = random.Random(51)
    rows, labels = [], []
    for i in range(240):
        toxic = i % 4 == 0
        rows.append((i, words(rng, 60) + (" vilewordish thing" if toxic else "")))
        labels.append((i, 1, int(toxic)))
    passage = words(rng, 55)
    rows += [(400, words(rng, 30) + " " + passage + " " + words(rng, 20)), (401, words(rng, 25) + " " + passage + " " + words(rng, 30))]
    rows += [(402, rows[1][1]), (403, rows[1][1] + " end"), (404, "write to ann@example.com now " + words(rng, 40)), (405, None), (406, ""), (None, words(rng, 40)), (404, rows[-1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "score": F.lit("clash"), "predicted": F.lit("clash"), "spans": F.lit("clash")}
    )
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*labels, (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    step, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, str(tmp_path)).persist()
        seen[name] = step
        if name != "packing":
            assert step.columns == docs.columns and all(r["score"] == r["predicted"] == r["spans"] == "clash" for r in step.collect())
    after = {name: [(r["doc_id"], r["text"]) for r in df.collect()] for name, df in seen.items() if name != "packing"}
    clean = [i for i in range(240) if i % 4]
    ids = [k for k, _ in after["toxicity"]]
    assert not any(k is not None and k < 240 and k % 4 == 0 for k in ids) and set(clean) <= set(ids) and {405, 406, None} <= set(ids)
    near = dict(after["simhash_near_dedup"])
    assert 402 not in near and 403 not in near and 1 in near and (405 in near) != (406 in near)  # null and empty texts are alike
    cut = dict(after["substring_dedup"])
    assert passage in cut[400] and passage not in cut[401]
    assert "[email]" in dict(after["pii"])[404] and "@" not in dict(after["pii"])[404]
    packed = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["ids_crc32"]) for r in seen["packing"].collect())
    whole = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert packed == whole and len(packed) == len(after["pii"])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert simhash.keep_one(spark.read.parquet(str(tmp_path / "documents.parquet"))).count() == 0
