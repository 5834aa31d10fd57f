"""Toxicity by a linear model that is held to the same score when identity terms are swapped."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palate.llm.common import map_texts, slices
from palate.sources.shared import forget, shared_table

#: Terms for groups of people, by kind, in four languages; a counterfactual replaces each with the next of its kind.
IDENTITY_TERMS = (
    ("women", "men", "people"), ("woman", "man", "person"), ("girls", "boys", "kids"), ("female", "male", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "citizen", "refugee"), ("immigrants", "citizens", "refugees"), ("old", "young"), ("disabled", "blind", "deaf"),
    ("femmes", "hommes", "personnes"), ("femme", "homme", "personne"), ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"), ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("immigrés", "citoyens", "réfugiés"), ("handicapés", "aveugles", "sourds"), ("homosexuels", "hétérosexuels", "lesbiennes", "transgenres"),
    ("frauen", "männer", "menschen"), ("frau", "mann", "mensch"), ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"), ("einwanderer", "bürger", "flüchtlinge"), ("behinderte", "blinde", "gehörlose"),
    ("schwule", "heterosexuelle", "lesben", "transsexuelle"), ("mujeres", "hombres", "personas"), ("mujer", "hombre", "persona"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"), ("negros", "blancos", "asiáticos", "africanos", "europeos"),
    ("inmigrantes", "ciudadanos", "refugiados"), ("discapacitados", "ciegos", "sordos"), ("homosexuales", "heterosexuales", "lesbianas", "transexuales"),
)
SWAP = {w: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, w in enumerate(kind)}
MENTIONS = tuple(SWAP)

BITS = 20
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """Hashes of a word, its beginnings of 3 to 6 letters and its 5-letter pieces."""
    parts = [f"={word}", *(f"^{word[:n]}" for n in range(3, 7) if len(word) > n), *(word[i : i + 5] for i in range(1, len(word) - 4))]
    return [xxhash.xxh32_intdigest(p) >> (32 - BITS) for p in parts]


def text_features(text: str | None) -> set[int]:
    return {f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)}


def counterfactual(text: str | None) -> str:
    """The text with its identity terms swapped; one that names no group, with a neutral mention of one, by its hash, at the end."""
    text = (text or "").lower()
    swapped = _WORD.sub(lambda m: SWAP.get(m[0], m[0]), text)
    return swapped if swapped != text else f"{text} {MENTIONS[xxhash.xxh32_intdigest(text.encode('utf-8', 'surrogatepass')) % len(MENTIONS)]}"


@dataclass
class Model:
    weights: dict[int, float]  # by feature; at most as many as fit() was asked for
    bias: float

    def scorer(self):
        known: dict[str, tuple[int, ...]] = {}
        weights = self.weights

        def score(text: str | None) -> float:
            present: set[int] = set()
            for w in set(_WORD.findall((text or "").lower())):
                hit = known.get(w)
                if hit is None:
                    if len(known) > 200_000:
                        known.clear()
                    hit = known[w] = tuple(f for f in word_features(w) if f in weights)
                if hit:
                    present.update(hit)
            z = self.bias + sum(weights[f] for f in sorted(present))
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def training_rows(labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """(doc_id, toxic) to learn from: documents whose crc32(doc_id) mod 3 is not 1, at most max_rows of them.

    The bounded sample is the rows with the smallest hash of the id. Rows without id or label are left out; of several
    labels for one document the larger counts."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def held_out(key) -> F.Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_features: int = 1000, swap_penalty: float = 1.0) -> Model:
    """Logistic regression over features that toxic documents hold more often, learned from training_rows().

    The loss adds swap_penalty times the mean squared change of the logit between a text and its counterfactual: its
    identity terms swapped or, where it names no group, a group mentioned. max_features bounds the model: the features
    with the largest gain among those of three toxic documents or more. What reaches the driver is bounded by max_rows
    and max_features, not by the corpus. Rows of one id are one document, with the least of their texts. Without
    documents of both labels the model scores every text with the share of toxic ones (one half if there is none)."""
    sample = F.broadcast(training_rows(labels, max_rows))  # at most max_rows pairs of numbers
    known = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    known = shared_table(known.select("doc_id", "text", "toxic"), "training")

    def counted(columns: list[list]) -> list[tuple]:
        n = np.zeros((2, 1 << BITS), np.int32)
        for _, text, toxic in zip(*columns):
            n[int(toxic > 0), list(text_features(text))] += 1
        at = np.flatnonzero(n.any(axis=0))
        return [(-1, sum(t > 0 for t in columns[2]), sum(t <= 0 for t in columns[2])), *zip(at.tolist(), n[1, at].tolist(), n[0, at].tolist())]

    counts = map_texts(known, "f int, pos long, neg long", counted, rows=2048).groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = shared_table(counts, "features")
    total = counts.filter("f = -1").first()
    n_pos, n_neg = (total["pos"], total["neg"]) if total else (0, 0)
    if not n_pos or not n_neg:
        share = n_pos / (n_pos + n_neg) if n_pos + n_neg else 0.5
        forget(known, counts)
        return Model({}, float(np.log((share + 1e-4) / (1 - share + 1e-4))))
    share_pos, share_neg = (F.col("pos") + 0.5) / (n_pos + 1), (F.col("neg") + 0.5) / (n_neg + 1)
    gain = share_pos * F.log(share_pos / share_neg)
    best = counts.filter("f >= 0 and pos >= 3").withColumn("gain", gain).filter("gain > 0").orderBy(F.desc("gain"), "f").limit(max_features)
    place = {r["f"]: i for i, r in enumerate(best.select("f").collect())}

    def chosen(columns: list[list]) -> list[tuple]:
        out = []
        for _, text, toxic in zip(*columns):
            plain, changed = (sorted(place[f] for f in text_features(t) if f in place) for t in (text, counterfactual(text)))
            out.append((int(toxic > 0), plain, changed))
        return out

    rows = map_texts(known, "toxic int, plain array<int>, changed array<int>", chosen).collect()  # max_rows at most
    forget(known, counts)
    w, b = _descend(rows, len(place), swap_penalty)
    return Model({f: float(w[i]) for f, i in place.items() if w[i]}, b)


def _descend(rows: list, n_features: int, swap_penalty: float, steps: int = 500, ridge: float = 2e-6) -> tuple[np.ndarray, float]:
    """Adam over the whole sample. rows: (toxic, features, features of the counterfactual)."""
    rows = sorted(rows)  # Spark may deliver them in any order
    y = np.array([r[0] for r in rows], float)
    flat = lambda k: (np.repeat(np.arange(len(rows)), [len(r[k]) for r in rows]), np.concatenate([np.array(r[k], int) for r in rows]))
    (ri, ci), (rs, cs) = flat(1), flat(2)
    changed = np.array([r[1] != r[2] for r in rows])
    keep_i, keep_s = changed[ri], changed[rs]
    w, b = np.zeros(n_features), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        z = np.bincount(ri, w[ci], len(y)) + b
        off = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        g = np.bincount(ci, off[ri], n_features) + ridge * w
        if changed.any():
            d = np.bincount(ri, w[ci], len(y)) - np.bincount(rs, w[cs], len(y))
            d *= 2 * swap_penalty / changed.sum()
            g += np.bincount(ci[keep_i], d[ri[keep_i]], n_features) - np.bincount(cs[keep_s], d[rs[keep_s]], n_features)
        g = np.append(g, off.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def score_documents(
    docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7, score: str = "score", predicted: str = "predicted"
) -> DataFrame:
    """docs with `score` (0 to 1) and `predicted` (1 from the threshold on); columns of docs with these names are replaced.

    A null or empty text gets the score of a text without any feature; repeated rows score alike. No shuffle; rows pass
    one by one."""
    kept = [c for c in docs.columns if c not in (score, predicted)]
    at = kept.index(text)
    out = docs.select(*kept)
    schema = T.StructType([*out.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())])

    def run(batches):
        of_text = model.scorer()
        for batch in slices(batches):
            scores = [of_text(t) for t in batch.column(at).to_pylist()]
            columns = [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, score, predicted])

    return out.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; see fit() and score_documents().

    A null id isn't held out; repeated rows give repeated results."""
    model = fit(docs, labels, **options)
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
