"""Toxicity: a convolutional text classifier.

Words are hashed to embeddings; filters of several widths run over them; each filter keeps its
maximum over the whole text; a logistic unit reads the maxima. The weights are trained with numpy on a
bounded sample of labelled documents. Scores depend on the text alone. Thresholds are calibrated by
language on counts of all labelled documents of a fold that the weights were not fitted to, whatever their
length and number.

Defined cases: a null text counts as empty; an empty text has the score of a text without any known
word; repeated rows get equal scores; rows keep their extra columns, but a column with the name of an
added one is replaced. Labels that are null count as missing, and of several labels of a document the
highest holds. Without labels of both kinds every score is 0. An unknown language, one with fewer than
``LEAST_OF_LANGUAGE`` documents of either kind in the fold, or a table without languages has the threshold of all
languages together. An empty table gives an empty result; texts of any length are read whole. The sample shows the
classifier at most ``MOST_KNOWN`` buckets of words, the most frequent ones; a word in any other is unknown and adds
nothing to a score.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField

from srcloom.llm.common import FOLDS, add_columns, arrow_ready, carried, fold, returned, text_words

# Bounds of the labelled sample: documents of each kind, and characters of a document in it.
SAMPLE_DOCS = 3000
SAMPLE_CHARS = 20_000

BUCKETS = 1 << 22
WIDTHS = (1, 2, 3)
FILTERS = 8
EMBEDDING = 12
LEAST_DOCS = 3
# Documents by which the log odds of a bucket are pulled to none: words of a few copied texts prove little.
SHRINK = 3
MOST_KNOWN = 60_000
EPOCHS = 12
BATCH = 32
THRESHOLD = 0.5
# A language needs so many documents of each kind for a threshold of its own.
LEAST_OF_LANGUAGE = 8
# Thresholds tried. They lie between 0.2 and 0.8, so that few documents cannot move a threshold far.
CUTS = np.linspace(0.2, 0.8, 61)


@dataclass
class Model:
    """row_of: embedding row by bucket, 0 for buckets the sample did not show. tables: by offset in a
    window, what a row adds to each filter that reaches so far. thresholds: by language, '' for all."""

    row_of: np.ndarray
    tables: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    intercept: float
    thresholds: dict[str, float]


def hashed_words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word, and the index of each text's first word."""
    words, firsts = text_words(texts)
    coded = words.dictionary_encode()
    unique = [zlib.crc32(w) % BUCKETS for w in coded.dictionary.to_pylist()]
    return np.array(unique, np.int32)[coded.indices.to_numpy()] if unique else np.empty(0, np.int32), firsts


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """One row for each labelled document, with its highest label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    return known.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled training documents: at most ``rows`` of each label, by the least hashes of their ids.

    Ids whose fold is 0 stay out. The ids are chosen from the labels alone, so what is sent to all
    tasks has at most two times ``rows`` entries. Texts over ``SAMPLE_CHARS`` characters stay out.
    """
    known = known_labels(labels, label).where(fold(F.col("doc_id")) != 0)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("_label = 0").orderBy(*order).limit(rows).unionAll(
        known.where("_label = 1").orderBy(*order).limit(rows)
    )
    texts = docs.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text")
    return texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    arrow_ready(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic")

    def encode(texts: pa.StringArray, _: pa.RecordBatch) -> list[pa.Array]:
        buckets, firsts = hashed_words(texts)
        return [pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(buckets))]

    coded = add_columns(
        sample, encode, [StructField("_words", ArrayType(IntegerType()))], ["doc_id", "_label"]
    ).withColumn("_fold", fold(F.col("doc_id")))
    rows = coded.orderBy("doc_id").toArrow()
    words = [np.asarray(x, np.int32) for x in rows.column("_words").to_pylist()]
    label = np.array(rows.column("_label").to_pylist(), np.int64)
    held = np.array(rows.column("_fold").to_pylist(), np.int64) == FOLDS - 1
    model = fit(words, label, held)
    if np.isfinite(model.intercept):
        counts = counted(docs, labels, model, fold(F.col("doc_id")) == FOLDS - 1)
        if {c[2] for c in counts} != {0, 1}:
            counts = counted(docs, labels, model, fold(F.col("doc_id")) != 0)
        model.thresholds = calibrated(counts)
    return model


def counted(docs: DataFrame, labels: DataFrame, model: Model, where: Column) -> list[tuple[str | None, int, int, int]]:
    """(lang, bin, label, documents) of all labelled documents with such ids; a bin is the number of ``CUTS`` that a
    score reaches. Texts are scored where they lie; only ids and bins meet the labels."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: pa.StringArray, _: pa.RecordBatch) -> list[pa.Array]:
        found = score_words(shared.value, *hashed_words(texts))
        return [pa.array(np.searchsorted(CUTS, found, side="right").astype(np.int32))]

    own = with_lang(docs).where(where).select("doc_id", "lang", "text")
    bins = add_columns(own, compute, [StructField("_bin", IntegerType())], ["doc_id", "lang"])
    known = known_labels(labels, "toxic").where(where & F.col("_label").isin(0, 1))
    sums = bins.join(known, "doc_id").groupBy("lang", "_bin", "_label").agg(F.count("*").alias("_n"))
    return [tuple(r) for r in sums.collect()]


def empty_model() -> Model:
    tables = [np.zeros((1, FILTERS * sum(w > j for w in WIDTHS)), np.float32) for j in range(max(WIDTHS))]
    n = FILTERS * len(WIDTHS)
    return Model(np.zeros(BUCKETS, np.uint16), tables, np.zeros(n), np.zeros(n), -np.inf, {"": THRESHOLD})


def fit(words: list[np.ndarray], label: np.ndarray, held: np.ndarray, seed: int = 7) -> Model:
    """Weights from the documents that are not held. Thresholds are calibrated later, on all documents."""
    used = ~held if len(set(label[~held])) == 2 else np.ones(len(label), bool)
    if len(set(label[used])) < 2:
        return empty_model()
    texts = [words[i] for i in np.flatnonzero(used)]
    target = label[used].astype(np.float64)

    # Known buckets: in LEAST_DOCS documents or more, the most frequent ones first.
    seen = [np.unique(w) for w in texts]
    flat = np.concatenate([*seen, np.empty(0, np.int32)])
    of_doc = np.repeat(target, [len(s) for s in seen])
    names, back, counts = np.unique(flat, return_inverse=True, return_counts=True)
    toxic = np.bincount(back, of_doc, len(names))
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] >= min(LEAST_DOCS, len(texts))][:MOST_KNOWN]
    row_of = np.zeros(BUCKETS, np.uint16)
    row_of[names[order]] = np.arange(1, len(order) + 1)

    # The first dimension starts as the log odds of a bucket, shrunk to none for rare ones, the others at random.
    rng = np.random.default_rng(seed)
    pos, neg = target.sum(), len(target) - target.sum()
    t, c = toxic[order], counts[order] - toxic[order]
    share = pos / (pos + neg)
    odds = np.log((t + SHRINK * share) / pos) - np.log((c + SHRINK * (1 - share)) / neg)
    embedding = np.zeros((len(order) + 1, EMBEDDING))
    embedding[1:] = rng.normal(0, 0.05, (len(order), EMBEDDING))
    embedding[1:, 0] = np.clip(odds, -3, 6) / 3
    kernels = [rng.normal(0, 0.2, (w, EMBEDDING, FILTERS)) for w in WIDTHS]
    for k in kernels:
        k[:, 0, : FILTERS // 2] = 1 / len(k)
    bias, weights, intercept = np.zeros(FILTERS * len(WIDTHS)), rng.normal(0.1, 0.1, FILTERS * len(WIDTHS)), 0.0

    # A text ends with rows of zeros, so that windows neither cross texts nor are missing.
    pad = np.zeros(max(WIDTHS), np.int64)
    rows = [np.concatenate([row_of[w].astype(np.int64), pad]) for w in texts]
    balance = np.where(target == 1, 0.5 / pos, 0.5 / neg) * len(target)
    params = [embedding, *kernels, bias, weights]
    sums = [np.full_like(p, 0.01) for p in params]
    intercept_sum = 0.01
    for epoch in range(EPOCHS):
        rate = 0.1 / (1 + epoch / 4)
        shuffled = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            own = shuffled[at : at + BATCH]
            best, where = [], []
            for width, kernel, shift in zip(WIDTHS, kernels, range(0, len(bias), FILTERS)):
                tables = [embedding @ kernel[j] for j in range(width)] if width == 1 else None
                for i in own:
                    r = rows[i]
                    n = len(r) - len(pad) + 1
                    if tables is not None:
                        z = tables[0][r[:n]]
                    else:
                        x = embedding[r]
                        z = sum(x[j : j + n] @ kernel[j] for j in range(width))
                    p = z.argmax(0)
                    where.append(p)
                    best.append(z[p, np.arange(FILTERS)])
            top = np.array(best).reshape(len(WIDTHS), len(own), FILTERS).transpose(1, 0, 2).reshape(len(own), -1)
            spot = np.array(where).reshape(len(WIDTHS), len(own), FILTERS)
            hidden = np.maximum(top + bias, 0)
            out = 1 / (1 + np.exp(-(hidden @ weights + intercept)))
            error = (out - target[own]) * balance[own] / len(own)
            grads = [None, *[np.zeros_like(k) for k in kernels], None, hidden.T @ error + 1e-4 * weights]
            inner = (error[:, None] * weights) * (hidden > 0)
            grads[-2] = inner.sum(0)
            touched, pushed = [], []
            for g, (width, kernel) in enumerate(zip(WIDTHS, kernels)):
                for d, i in enumerate(own):
                    e = inner[d, g * FILTERS : (g + 1) * FILTERS]
                    for j in range(width):
                        ids = rows[i][spot[g, d] + j]
                        grads[1 + g][j] += embedding[ids].T * e
                        touched.append(ids)
                        pushed.append((kernel[j] * e).T)
            ids, back = np.unique(np.concatenate(touched), return_inverse=True)
            step = np.zeros((len(ids), EMBEDDING))
            np.add.at(step, back, np.concatenate(pushed))
            sums[0][ids] += step**2
            embedding[ids] -= rate * step / np.sqrt(sums[0][ids])
            embedding[0] = 0
            for p, s, g in zip(params[1:], sums[1:], grads[1:]):
                s += g**2
                p -= rate * g / np.sqrt(s)
            intercept_sum += error.sum() ** 2
            intercept -= rate * error.sum() / np.sqrt(intercept_sum)

    tables = [
        np.concatenate([embedding @ k[j] for k in kernels if len(k) > j], axis=1).astype(np.float32)
        for j in range(max(WIDTHS))
    ]
    return Model(row_of, tables, bias, weights, intercept, {"": THRESHOLD})


def calibrated(counts: list[tuple[str | None, int, int, int]]) -> dict[str, float]:
    """By language, the middle of the cuts with the fewest errors, a missed and a wrong one alike."""
    by_lang: dict[str, np.ndarray] = {"": np.zeros((2, len(CUTS) + 1), np.int64)}
    for lang, reached, label, n in counts:
        own = by_lang.setdefault(lang or "", np.zeros((2, len(CUTS) + 1), np.int64))
        own[label, reached] += n

    def best(own: np.ndarray) -> float:
        clean, toxic = np.cumsum(own, axis=1)
        wrong = toxic[:-1] + clean[-1] - clean[:-1]
        good = CUTS[wrong == wrong.min()]
        return float(good[np.argmin(np.abs(good - THRESHOLD))])

    found = {"": best(sum(by_lang.values()))}
    for lang in sorted({*by_lang} - {""}):
        if by_lang[lang].sum(axis=1).min() >= LEAST_OF_LANGUAGE:
            found[lang] = best(by_lang[lang])
    return found


def score_words(model: Model, buckets: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Scores of texts given as buckets; text i is buckets[firsts[i]:firsts[i + 1]]."""
    n, longest = len(firsts) - 1, max(WIDTHS)
    if not n:
        return np.empty(0)
    # Each text with its rows of zeros behind it.
    starts = firsts[:-1] + longest * np.arange(n)
    rows = np.zeros(firsts[-1] + longest * n, np.int64)
    at = np.arange(len(buckets)) + longest * np.repeat(np.arange(n), np.diff(firsts))
    rows[at] = model.row_of[buckets]
    z = model.tables[0][rows]
    for j in range(1, longest):
        reach = model.tables[j].shape[1]
        z[: len(rows) - j, z.shape[1] - reach :] += model.tables[j][rows[j:]]
    # Windows that start in the last rows of zeros would reach into the next text.
    edge = (starts + np.diff(firsts))[:, None] + np.arange(1, longest)
    z[edge.ravel()] = -np.inf
    top = np.maximum.reduceat(z, starts, axis=0)
    value = np.maximum(top + model.bias, 0) @ model.weights + model.intercept
    return 1 / (1 + np.exp(-np.clip(value, -500, 500)))


def with_lang(docs: DataFrame) -> DataFrame:
    """A table without languages has null ones, which the threshold of all languages serves."""
    return docs if "lang" in {c.lower() for c in docs.columns} else docs.withColumn("lang", F.lit(None).cast("string"))


def with_scores(docs: DataFrame, model: Model, keep: list[str], score: str = "score") -> DataFrame:
    """Adds the score of every whole text, and ``score_cut``, the threshold of its language."""
    arrow_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: pa.StringArray, also: pa.RecordBatch) -> list[pa.Array]:
        own = shared.value
        buckets, firsts = hashed_words(texts)
        cuts = own.thresholds
        langs = also.column(0).to_pylist()
        return [
            pa.array(score_words(own, buckets, firsts)),
            pa.array([cuts.get(x or "", cuts[""]) for x in langs], pa.float64()),
        ]

    fields = [StructField(score, DoubleType()), StructField(f"{score}_cut", DoubleType())]
    return add_columns(with_lang(docs), compute, fields, keep, also=["lang"])


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents whose score stays below the threshold of their language, with all their columns."""
    own, names = carried(docs, ["doc_id", "text", "lang"])
    scored = with_scores(own, train(own, labels), names)
    return returned(scored.where("score < score_cut"), docs)
