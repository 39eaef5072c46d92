"""Text quality from compression with dictionaries of good and bad text.

Two zstandard dictionaries are trained, one on good and one on bad labelled
documents. A text is cut into short blocks, all of them, and each block is
compressed with either dictionary: the kind of text it resembles makes it
smaller. The difference of the two total sizes over their sum is the feature; a
logistic curve, fitted on labelled documents that neither dictionary has seen,
makes it a probability.

Only labelled rows outside the held-out fold train, and of these a bounded
sample (``Settings``), of long texts a stretch whose place is set by a hash. A label that is given more than once counts by its mean.
Missing text is empty; an empty text gets the curve's value at no difference.
With labels of one kind only, or none, all scores are the share of good labels
(0.5 without labels). Repeated rows are scored row by row. An empty table gives
an empty result. Further columns are left out.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvergrain.llm.common import by_batch, hold, id_bucket, record, stretch, texts


@dataclass(frozen=True)
class Settings:
    """``train_docs`` rows of each label in expectation (by hash of the id) train on the driver, each with up to ``train_chars`` characters."""
    train_docs: int = 2_000
    train_chars: int = 20_000
    block: int = 512
    dictionary: int = 512 << 10
    level: int = 3
    threshold: float = 0.7


def held_out(column: str = "doc_id") -> Column:
    """The fold whose labels are never seen."""
    return id_bucket(4, column) == 2


def blocks(text: str, size: int) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return [raw[i:i + size] for i in range(0, len(raw), size)]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; with too little text to train on, the text itself."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, max(total // 8, 1 << 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Model:
    """Two dictionaries and a curve; what is sent to the workers."""

    def __init__(self, settings: Settings, bad: bytes, good: bytes, curve: tuple[float, float]):
        self.settings, self.bad, self.good, self.curve = settings, bad, good, curve
        self._pair = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def release(self) -> None:
        self._pair = None

    def _compressors(self):
        if self._pair is None:
            level, self._pair = self.settings.level, []
            for raw in (self.bad, self.good):
                loaded = zstandard.ZstdCompressionDict(raw)
                loaded.precompute_compress(level=level)
                self._pair.append(zstandard.ZstdCompressor(
                    level=level, dict_data=loaded, write_checksum=False, write_content_size=False, write_dict_id=False))
        return self._pair

    def difference(self, text: str) -> float:
        """(size with the bad dictionary - size with the good one) / their sum, over all blocks."""
        if not (self.bad and self.good):
            return 0.0
        bad, good = self._compressors()
        parts = blocks(text, self.settings.block)
        a, b = sum(len(bad.compress(p)) for p in parts), sum(len(good.compress(p)) for p in parts)
        return (a - b) / (a + b) if parts else 0.0

    def score(self, differences: np.ndarray) -> np.ndarray:
        slope, level = self.curve
        return 1 / (1 + np.exp(-np.clip(slope * differences + level, -500, 500)))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and level of a logistic curve by Newton steps, lightly shrunk so that parted classes stay finite."""
    scale = float(np.std(x)) or 1.0
    design = np.stack([x / scale, np.ones_like(x)], 1)
    weights = np.zeros(2)
    shrink = np.diag([1e-2, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        step = np.linalg.solve(design.T * (p * (1 - p)) @ design + shrink, design.T @ (y - p) - shrink @ weights)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return float(weights[0] / scale), float(weights[1])


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fits on a bounded sample of labelled rows outside the held-out fold."""
    known = (labels.where(~held_out() & F.col("quality").isNotNull()).groupBy("doc_id")
             .agg((F.avg("quality") >= 0.5).cast("int").alias("good")))
    all_of = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = {kind: min(1.0, settings.train_docs / n) for kind, n in all_of.items()}
    chosen = known.where(spot < F.when(F.col("good") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0)))
    rows = (texts(docs).join(F.broadcast(chosen), "doc_id")
            .select("doc_id", "good", stretch(settings.train_chars).alias("text")).collect())  # about train_docs of each label
    rows.sort()
    parts = {kind: [r["text"] for r in rows if r["good"] == kind] for kind in (0, 1)}
    bad_rows, good_rows = max(all_of.get(0, 0), 1e-6), max(all_of.get(1, 0), 1e-6)
    prior = float(np.log(good_rows / bad_rows)) if all_of else 0.0
    if min(map(len, parts.values())) < 2:
        return Model(settings, b"", b"", (0.0, prior))
    seen = {k: [b for t in v[::2] for b in blocks(t, settings.block)] for k, v in parts.items()}
    model = Model(settings, dictionary(seen[0], settings.dictionary), dictionary(seen[1], settings.dictionary), (0.0, 0.0))
    unseen = [(model.difference(t), k) for k, v in parts.items() for t in v[1::2]]
    x, y = np.array([d for d, _ in unseen]), np.array([k for _, k in unseen], float)
    slope, level = fit_curve(x, y)
    # the sample has its own mix of labels; the level moves to that of all labelled rows
    sampled = float(np.log(max(y.sum(), 1) / max(len(y) - y.sum(), 1)))
    model.curve = (slope, level + prior - sampled)
    return model


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` of every whole text; a scan with no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size

    def score(batches):
        model = sent.value
        hold(model)
        for batch in batches:
            found = model.score(np.array([model.difference(t.as_py()) for t in batch.column(1)], float))
            yield record(doc_id=batch.column(0), score=found,
                         predicted=((found >= model.settings.threshold).astype(np.int32), pa.int32()))

    return by_batch(texts(docs), score, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents themselves, without those whose score is below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches):
        model = sent.value
        hold(model)
        for batch in batches:
            found = model.score(np.array([model.difference(t.as_py() or "") for t in batch.column(at)], float))
            yield batch.filter(pa.array(found >= model.settings.threshold))

    return by_batch(docs, keep, docs.schema)
