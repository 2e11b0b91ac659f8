"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1; unlabelled web text is a sample of all
documents, whatever their labels. A small network minimises the non-negative unbiased risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]),

where the class prior is estimated from the labelled training documents. Features describe the form
of a text: shares of byte classes and single ASCII symbols, repeated words, lines, word lengths.
Scores are shifted so that the cut at ``CUT`` falls into the widest gap between the outputs of all documents
outside fold 0, near the quantile that the class prior leaves below it. The outputs are counted in bins; where they
lie so close that no gap is as wide as a bin, the cut falls into the bin with the fewest documents.

Defined cases: a null text counts as empty; an empty text has features of zeros and a score like any
other; repeated rows get equal scores; a kept column with the name of an added one is replaced. Labels
that are null count as missing, and of several labels of a document the highest holds. Without trusted
positives or without unlabelled texts every score is 1. An empty table gives an empty result; texts of any length
are read whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField

from srcloom.llm.common import add_columns, arrow_ready, carried, fold, returned, text_bytes, text_words

# Bounds of the samples, in documents: trusted positives, unlabelled texts.
POSITIVES = 5000
UNLABELLED = 8000

HIDDEN = 16
EPOCHS = 40
BATCH = 500
# A score of CUT or more counts as good.
CUT = 0.3
# Prior where no labelled document tells it, and its limits.
PRIOR, LEAST_PRIOR, MOST_PRIOR = 0.8, 0.05, 0.98
# Share of the documents, on each side of the quantile, among which the gap is sought.
NEAR = 0.04
# Bins for one unit of the network's output, and its limits for the bins.
BINS, MOST_OUTPUT = 256, 64


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    shift: float
    prior: float


def features(texts: pa.StringArray) -> np.ndarray:
    """A row of numbers for each text; all are shares or logarithms, so that length alone means little."""
    n = len(texts)
    data, offsets = text_bytes(texts)
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(n), sizes)
    counts = np.bincount(owner * 129 + np.minimum(data, 128), minlength=n * 129).reshape(n, 129).astype(float)
    some = np.maximum(sizes, 1)[:, None]
    symbols = counts[:, [*range(0x20, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F), 10]]
    groups = np.stack(
        [
            counts[:, 0x30:0x3A].sum(1),
            counts[:, 0x41:0x5B].sum(1),
            counts[:, 0x61:0x7B].sum(1),
            counts[:, 128],
            counts[:, :0x20].sum(1),
        ],
        1,
    )
    # Symbols next to the same symbol, as in runs of marks.
    same = np.zeros(n)
    if len(data) > 1:
        twin = (data[1:] == data[:-1]) & (owner[1:] == owner[:-1]) & (data[1:] < 0x80)
        same = np.bincount(owner[1:][twin], minlength=n).astype(float)
    words, firsts = text_words(texts)
    held = np.diff(firsts)
    code = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    home = np.repeat(np.arange(n), held)
    pairs = np.unique(home * (len(code) + 1) + code)
    distinct = np.bincount(pairs // (len(code) + 1), minlength=n) if len(code) else np.zeros(n)
    echo = np.zeros(n)
    if len(code) > 1:
        twin = (code[1:] == code[:-1]) & (home[1:] == home[:-1])
        echo = np.bincount(home[1:][twin], minlength=n).astype(float)
    many = np.maximum(held, 1)
    return np.concatenate(
        [
            np.sqrt(symbols / some),
            np.sqrt(groups / some),
            np.sqrt(same / some[:, 0])[:, None],
            np.sqrt(echo / many)[:, None],
            # Distinct words grow slower than words, so the share is taken of a power of the count.
            (distinct / many**0.8)[:, None],
            np.log1p(sizes / many)[:, None],
            np.log1p(held)[:, None] / 5,
            np.log1p(counts[:, 10] / many)[:, None],
        ],
        axis=1,
    )


def _collected(rows: DataFrame, extra: list[str]) -> tuple[np.ndarray, list[list]]:
    def compute(texts: pa.StringArray, _: pa.RecordBatch) -> list[pa.Array]:
        made = features(texts)
        bounds = np.arange(0, made.size + 1, made.shape[1], dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(bounds), pa.array(made.ravel()))]

    coded = add_columns(rows, compute, [StructField("_x", ArrayType(DoubleType()))], ["doc_id", *extra])
    found = coded.orderBy("doc_id").toArrow()
    return np.array(found.column("_x").to_pylist(), float), [found.column(c).to_pylist() for c in extra]


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on at most ``POSITIVES`` trusted and ``UNLABELLED`` other texts, chosen by hashes of their ids; the shift
    comes from all documents outside fold 0.

    No others take part. What goes to all tasks is a list of ids of that bound, then the model.
    """
    arrow_ready(docs.sparkSession)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("_good"))
    )
    seen = known.agg(F.avg((F.col("_good") == 1).cast("double")), F.count("*")).first()
    prior = float(np.clip(seen[0], LEAST_PRIOR, MOST_PRIOR)) if seen[1] else PRIOR
    trusted = known.where("_good = 1").orderBy(*order).limit(POSITIVES).select("doc_id", F.lit(1).alias("_good"))
    own = docs.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).select("doc_id", "text")
    # The same hash under another seed, so that the samples are independent of each other.
    others = own.select("doc_id").distinct().orderBy(F.xxhash64(F.lit("web"), "doc_id"), "doc_id").limit(UNLABELLED)
    chosen = trusted.unionAll(others.select("doc_id", F.lit(0).alias("_good")))
    x, (good,) = _collected(own.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "_good"]), ["_good"])
    mask = np.array(good, int) == 1
    if not mask.any() or mask.all():
        return None
    model = fit(x[mask], x[~mask], prior)
    model.shift = gap(counted(own, model), 1 - prior)
    return model


def counted(docs: DataFrame, model: Model) -> list[tuple[int, float, float]]:
    """(documents, least output, greatest output) of the bins that have any, in their order."""
    scored = _with(docs, outputs, model, [], "_output")
    limited = F.greatest(F.least(F.col("_output"), F.lit(float(MOST_OUTPUT))), F.lit(-float(MOST_OUTPUT)))
    sums = scored.groupBy(F.floor(limited * BINS).alias("_bin")).agg(
        F.count("*").alias("n"), F.min("_output").alias("least"), F.max("_output").alias("most")
    )
    return [(r.n, r.least, r.most) for r in sorted(sums.collect(), key=lambda r: r["_bin"])]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = np.clip((positive - mean) / scale, -6, 6), np.clip((unlabelled - mean) / scale, -6, 6)
    d = p.shape[1]
    params = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(v) for v in params], [np.zeros_like(v) for v in params]

    def output(x):
        hidden = np.tanh(x @ params[0] + params[1])
        return hidden, hidden @ params[2] + params[3][0]

    def gradient(x, hidden, on_output):
        back = (on_output[:, None] * params[2]) * (1 - hidden**2)
        return [x.T @ back, back.sum(0), hidden.T @ on_output, np.array([on_output.sum()])]

    step = 0
    for epoch in range(EPOCHS):
        rate = 0.01 / (1 + epoch / 10)
        for own in np.array_split(rng.permutation(len(u)), max(1, len(u) // BATCH)):
            xp = p[rng.integers(0, len(p), min(BATCH, len(p)))]
            xu = u[own]
            (hp, gp), (hu, gu) = output(xp), output(xu)
            sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
            # Sigmoid loss: l(g) = 1 - s(g), so l(-g) = s(g); both have the derivative s(1 - s) but for the sign.
            dp, du = sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
            negative = su.mean() - prior * sp.mean()
            if negative >= 0:
                on_p, on_u = -2 * prior * dp, du
            else:
                on_p, on_u = prior * dp, -du
            grads = [a + b for a, b in zip(gradient(xp, hp, on_p), gradient(xu, hu, on_u))]
            step += 1
            for k, g in enumerate(grads):
                g = g + 1e-4 * params[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    # The outer bias is the same for all texts, so the shift takes it in.
    return Model(mean, scale, params[0], params[1], params[2], 0.0, prior)


def gap(bins: list[tuple[int, float, float]], share: float) -> float:
    """Middle of the widest gap between outputs near their quantile ``share``, or of the emptiest bin there."""
    below = np.cumsum([b[0] for b in bins])
    n = int(below[-1])
    if n < 2:
        return bins[0][1] - 1
    low = int(np.clip(np.floor((share - NEAR) * n), 1, n - 1))
    high = int(np.clip(np.ceil((share + NEAR) * n), low + 1, n))
    # Between neighbouring bins, where so many outputs lie below that the cut is near the quantile.
    gaps = [(b[1] - a[2], a[2], b[1]) for a, b, k in zip(bins, bins[1:], below) if low <= k < high]
    if gaps and (widest := max(gaps, key=lambda g: g[0]))[0] >= 1 / BINS:
        return (widest[1] + widest[2]) / 2
    near = [b for b, k in zip(bins, below) if k > low - 1 and k - b[0] < high]
    emptiest = min(near, key=lambda b: b[0])
    return (emptiest[1] + emptiest[2]) / 2


def outputs(model: Model, x: np.ndarray) -> np.ndarray:
    """What the network makes of features, before the shift."""
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    return np.tanh(z @ model.inner + model.inner_bias) @ model.outer


def scores(model: Model | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.ones(len(x))
    value = outputs(model, x) - model.shift + np.log(CUT / (1 - CUT))
    return 1 / (1 + np.exp(-np.clip(value, -500, 500)))


def with_scores(docs: DataFrame, model: Model | None, keep: list[str], score: str = "score") -> DataFrame:
    """Adds the score of every whole text."""
    return _with(docs, scores, model, keep, score)


def _with(docs: DataFrame, value: Callable, model: Model | None, keep: list[str], name: str) -> DataFrame:
    arrow_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: pa.StringArray, _: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(value(shared.value, features(texts)))]

    return add_columns(docs, compute, [StructField(name, DoubleType())], keep)


def reject_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with a score of ``CUT`` or more, with all their columns."""
    own, names = carried(docs, ["doc_id", "text"])
    scored = with_scores(own, train(own, labels), names)
    return returned(scored.where(F.col("score") >= CUT), docs)
