"""The cut of the quality scores comes from all documents outside fold 0, not from a sample of them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from srcloom.llm import quality
from srcloom.llm.common import fold, table

SF_DIR = "/root/testdata/sf0.01"


def plain_gap(values, share):
    """Middle of the widest gap between neighbours near the quantile."""
    values, n = np.sort(values), len(values)
    low, high = int(np.floor((share - quality.NEAR) * n)), int(np.ceil((share + quality.NEAR) * n))
    at = max(range(max(low, 1), min(high, n)), key=lambda k: values[k] - values[k - 1])
    return (values[at] + values[at - 1]) / 2


def test_cut_counts_every_document(spark, monkeypatch):
    monkeypatch.setattr(quality, "UNLABELLED", 60)
    docs = table(spark, SF_DIR, "documents")
    model = quality.train(docs, table(spark, SF_DIR, "labels"))
    texts = [r.text or "" for r in docs.where(fold(F.col("doc_id")) != 0).collect()]
    values = quality.outputs(model, quality.features(pa.array(texts)))
    assert abs(model.shift - plain_gap(values, 1 - model.prior)) < 1e-9


def test_gap_of_bins():
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(-2, 0.2, 300), rng.normal(2, 0.2, 700)])
    places = np.floor(values * quality.BINS)
    bins = [(int((places == p).sum()), values[places == p].min(), values[places == p].max()) for p in np.unique(places)]
    assert quality.gap(bins, 0.3) == plain_gap(values, 0.3)
    # Outputs without a gap: the emptiest bin near the quantile.
    width = 1 / quality.BINS
    dense = [(5 if k == 31 else 100, k * width, (k + 0.9) * width) for k in range(100)]
    assert quality.gap(dense, 0.3) == (31 + 31.9) * width / 2
    assert quality.gap([(1, 0.5, 0.5)], 0.3) == -0.5 and quality.gap([(9, 0.5, 0.5)], 0.3) == 0.5
