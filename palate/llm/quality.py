"""Quality by compression: a text is good if it shrinks more beside good text than beside bad text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palate.llm.common import map_texts
from palate.llm.toxicity import score_documents
from palate.sources.shared import forget, shared_table

CHUNK, LEVEL = 2048, 3  # bytes that are compressed at a time; zstandard's level
SAMPLE = 256  # bytes of one of the samples that a dictionary is trained on
DICTIONARY = 65_536  # bytes of a dictionary at most
SHORT = 100  # a text of so many bytes counts half as short


def chunks(text: str | None, size: int = CHUNK) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary of the samples; their bytes as they stand where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY]


@dataclass
class Model:
    bad: bytes
    good: bytes
    slope: float
    shortness: float
    bias: float

    def sizes(self):
        """A function that gives a text's compressed sizes beside bad and beside good text, and its own, in bytes.

        A text is compressed whole, in chunks, so that what counts is the dictionary, not what the text itself has
        shown before."""
        made = []
        for data in (self.bad, self.good):
            known = zstandard.ZstdCompressionDict(data)
            known.precompute_compress(level=LEVEL)
            made.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
                if data
                else zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
            )

        def measure(text: str | None) -> tuple[int, int, int]:
            parts = chunks(text)
            bad, good = (sum(len(c.compress(p)) for p in parts) for c in made)
            return bad, good, sum(map(len, parts))

        return measure

    def scorer(self):
        measure = self.sizes() if self.slope else None

        def score(text: str | None) -> float:
            z = self.bias
            if measure:
                difference, short = normalised(*measure(text))
                z += self.slope * difference + self.shortness * short
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def normalised(bad: float, good: float, size: float) -> tuple[float, float]:
    """The difference of the compressed sizes by the text's size, and how short the text is (1 where it is empty)."""
    return (bad - good) / (size + SHORT), SHORT / (size + SHORT)


def held_out(key) -> F.Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def training_rows(labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """(doc_id, quality) to learn from: documents whose crc32(doc_id) mod 4 is not 2, the max_rows of smallest hash.

    Rows without id or label are left out; of several labels for one document the larger counts."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality is not null")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("quality"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_samples: int = 16_384) -> Model:
    """Dictionaries from two thirds of training_rows(), a logistic calibration of the size difference from the other third.

    Each label's dictionary is trained on the max_samples pieces (of SAMPLE bytes) of smallest hash, wherever they stand
    in their texts. What reaches the driver is bounded by max_rows and max_samples, not by the corpus. Rows of one id are
    one document, with the least of their texts. Where the third lacks a label, all rows calibrate; without documents
    of both labels every text gets the share of good ones (one half if there is none)."""
    sample = F.broadcast(training_rows(labels, max_rows))  # at most max_rows pairs of numbers
    known = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    own = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(3)) > 0
    known = shared_table(known.select("text", "quality", own.alias("own")), "training")
    n = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        forget(known)
        share = n.get(1, 0) / sum(n.values()) if n else 0.5
        return Model(b"", b"", 0.0, 0.0, float(np.log((share + 1e-4) / (1 - share + 1e-4))))

    def cut(columns: list[list]) -> list[tuple]:
        rows = []
        for text, quality in zip(*columns):
            rows += [(quality, xxhash.xxh64_intdigest(c) >> 1, c) for c in chunks(text, SAMPLE)]
        return rows

    cuts = map_texts(known.filter("own").select("text", "quality"), "quality int, place long, chunk binary", cut).dropDuplicates(["quality", "place"])
    found = [
        [bytes(r["chunk"]) for r in cuts.filter(F.col("quality") == q).orderBy("place").limit(max_samples).collect()]  # max_samples at most
        for q in (0, 1)
    ]
    bare = Model(*(build_dictionary(f) for f in found), 1.0, 0.0, 0.0)

    def measured(columns: list[list], measure) -> list[tuple]:
        return [(quality, own, *measure(text)) for text, quality, own in zip(*columns)]

    schema = "quality int, own boolean, bad long, good long, size long"
    rows = map_texts(known.select("text", "quality", "own"), schema, measured, setup=bare.sizes).collect()  # max_rows at most
    forget(known)
    apart = [r for r in rows if not r["own"]]
    if len({r["quality"] for r in apart}) == 2:
        rows = apart
    x = np.array([normalised(r["bad"], r["good"], r["size"]) for r in sorted(rows)])
    y = np.array([r["quality"] for r in sorted(rows)], float)
    return Model(bare.bad, bare.good, *calibrate(x, y))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 100) -> tuple[float, float, float]:
    """Weights of a logistic model by Newton steps: of the difference, of shortness, and the bias."""
    scale = x[:, 0].std() or 1.0
    a = np.column_stack([x[:, 0] / scale, x[:, 1], np.ones(len(x))])
    w = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(3), a.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1]), float(w[2])


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; see fit().

    A null or empty text has no size difference and gets the calibrated score of the shortest text. A null id isn't held
    out; repeated rows give repeated results; an empty table gives no rows; other columns don't matter."""
    scored = score_documents(docs.select("doc_id", "text"), fit(docs, labels, **options))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
