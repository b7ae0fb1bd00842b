"""Supervised subword embeddings for document quality.

Words and byte 3- and 4-grams are hashed to buckets; every bucket has a learned
vector. A document is the average of its features' vectors, and a softmax layer
over that average gives the classes. Trained by numpy stochastic gradient
descent on a bounded sample of labelled rows. As average and output layer are
linear, a trained model scores with the buckets' own logits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, raw_texts, slices, word_hashes

_BLOCK = 1 << 20


@dataclass
class QualityModel:
    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    @property
    def margins(self) -> np.ndarray:
        """Each bucket's logit of class 1 less that of class 0."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32)


def features(text: bytes, buckets: int):
    """Arrays of bucket numbers, one per block of a whole text. Letter case counts."""
    bits = buckets.bit_length() - 1
    data = b" " + b" ".join(text.split()) + b" "
    if len(data) < 3:
        return
    at = 0
    while at < len(data):
        # blocks end between words where there is one, so that no word is cut
        end = len(data) if at + _BLOCK >= len(data) else data.rfind(b" ", at + 1, at + _BLOCK)
        end = at + _BLOCK if end <= at else end
        chunk = data[at:end]
        words = word_hashes(chunk.strip())[0]
        a = np.frombuffer(data, np.uint8, offset=at, count=min(end + 3, len(data)) - at).astype(np.uint32)
        tri = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
        four = (tri[:-1] << np.uint32(8)) | a[3:]
        got = [(words >> np.uint64(64 - bits)).astype(np.int64)]
        for code, seed in ((tri, 0x68E31DA4), (four, 0xB5297A4D)):
            h = (code[: end - at] + np.uint32(seed)) * np.uint32(0x9E3779B1)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            got.append((h >> np.uint32(32 - bits)).astype(np.int64))
        yield np.concatenate(got)
        at = end


def train_numpy(rows: list[tuple[int, np.ndarray, np.ndarray]], buckets: int, dim: int, epochs: int, rate: float, seed: int, least_steps: int = 12_000) -> QualityModel:
    """rows: class, buckets, shares of the document's features. Classes weigh the same.

    A small sample is gone over more often, for ``least_steps`` in all.
    """
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    w, b = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    n = np.bincount([r[0] for r in rows], minlength=2)
    if not n.all():
        b[:] = [0.0, 2.0] if n[1] or not n[0] else [2.0, 0.0]
        return QualityModel(e * 0, w, b)
    weight = len(rows) / (2.0 * n)
    epochs = max(epochs, -(-least_steps // len(rows)))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            y, at, share = rows[i]
            lr = rate * (1 - done / steps)
            h = share @ e[at]
            z = h @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= np.float32(min(weight[y], 4.0) * lr)
            back = w @ p
            w -= np.outer(h, p)
            b -= 0.1 * p
            e[at] -= np.outer(np.sqrt(share), back)  # the root keeps rare features learning
            done += 1
    return QualityModel(e, w, b)


def fit(
    train: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_class: int = 1500,
    buckets: int = 1 << 15,
    dim: int = 8,
    epochs: int = 8,
    rate: float = 0.5,
    seed: int = 7,
) -> QualityModel:
    """Fit on labelled rows: labels 0 or 1 (others and nulls are left out), joined by id.

    ``per_class`` bounds the expected number of labels drawn per class, by a hash
    of the id; a null text counts as empty. With one class or none, the score is
    a constant.
    """
    lab = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col), F.col(label_col).cast("int").alias("_y")).distinct()
    counts = {r[0]: r[1] for r in lab.groupBy("_y").count().collect()}
    rate_of = F.lit(0.0)
    for y, n in counts.items():
        rate_of = F.when(F.col("_y") == y, F.lit(min(1.0, per_class / n))).otherwise(rate_of)
    draw = F.pmod(F.xxhash64(F.lit("quality"), F.col(id_col)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = F.broadcast(lab.where(draw < rate_of))  # at most about 2 * per_class rows

    def vectors(batches):
        for b in batches:
            out = []
            for y, text in zip(b.column(0).to_pylist(), raw_texts(b.column(1)), strict=True):
                c = np.zeros(buckets, np.int64)
                for f in features(text or b"", buckets):
                    c += np.bincount(f, minlength=buckets)
                at = np.flatnonzero(c)
                out.append((y, at.astype(np.uint32).tobytes(), c[at].astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["y", "at", "n"])

    joined = train.select(id_col, text_col).join(drawn, id_col).select("_y", text_col)
    got = joined.mapInArrow(vectors, "y int, at binary, n binary").collect()
    rows = []
    for y, at, n in sorted((r[0], bytes(r[1]), bytes(r[2])) for r in got):
        c = np.frombuffer(n, np.uint32).astype(np.float32)
        rows.append((y, np.frombuffer(at, np.uint32).astype(np.int64), c / max(c.sum(), 1.0)))
    return train_numpy(rows, buckets, dim, epochs, rate, seed)


def _scorer(model: QualityModel):
    margins, bias, buckets = model.margins, float(model.bias[1] - model.bias[0]), len(model.vectors)

    def scores(column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for i, text in enumerate(raw_texts(column)):
            total, n = 0.0, 0
            for f in features(text or b"", buckets):
                total += float(margins[f].sum(dtype=np.float64))
                n += len(f)
            out[i] = total / max(n, 1) + bias
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))

    return scores


def score(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1, the probability of class 1) of every whole text.

    Only the id and the text are read. A null text scores as an empty one, by the
    bias alone; repeated rows score alike; long texts are read in blocks, whole.
    An empty table gives an empty result.
    """
    scores = _scorer(model)

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(b.column(1)))], names=[id_col, "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def keep(df: DataFrame, model: QualityModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score at least ``threshold``. No shuffle."""
    scores, at, names = _scorer(model), df.columns.index(text_col), df.columns

    def run(batches):
        for b in slices(batches):
            kept = b.filter(pa.array(scores(b.column(at)) >= threshold))
            yield pa.RecordBatch.from_arrays(kept.columns, names=names)

    return by_place(df).mapInArrow(run, df.schema)
