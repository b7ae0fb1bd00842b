"""Language identification by nearest centroid.

Texts become L2-normalised TF-IDF vectors of hashed byte n-grams (2 to 4) of
their lower-cased letters. Each language has several centroids, found by
spherical k-means over a bounded sample; a text gets the language of the
centroid with the greatest cosine. A text that lies farther from that centroid
than its training texts did is marked as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, slices

LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that aren't letters separate words.
_TABLE = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_BLOCK = 1 << 20
#: Rows of dense vectors held at once.
_ROWS = 256


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray
    dims: int


def ngram_counts(text: str, dims: int) -> np.ndarray:
    """Counts of hashed byte 2-, 3- and 4-grams of a whole text, in blocks."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_TABLE).split()) + b" "
    out = np.zeros(dims, np.int64)
    shift = np.uint32(32 - (dims.bit_length() - 1))
    for at in range(0, len(data), _BLOCK):
        a = np.frombuffer(data, np.uint8, offset=at, count=min(_BLOCK + 3, len(data) - at)).astype(np.uint32)
        code = a
        for n in (2, 3, 4):
            code = (code[:-1] << np.uint32(8)) | a[n - 1 :]
            own = code[:_BLOCK]
            out += np.bincount((own * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> shift, minlength=dims)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def _clusters(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, the others the farthest texts."""
    centres = [x.mean(0)]
    while len(centres) < min(k, len(x)):
        near = np.max(x @ np.stack([c / max(np.linalg.norm(c), 1e-9) for c in centres]).T, axis=1)
        centres.append(x[int(near.argmin())])
    c = np.stack(centres)
    for _ in range(rounds):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        mine = (x @ c.T).argmax(1)
        c = np.stack([x[mine == i].mean(0) if (mine == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def fit(
    train: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    clusters: int = 4,
    per_lang: int = 400,
    max_rows: int = 4000,
    dims: int = 8192,
) -> LanguageModel:
    """Fit on a bounded sample of rows with a language and a text.

    ``per_lang`` (and ``max_rows`` over all languages) bounds the expected size
    of the sample, which is chosen by a hash of the id. Rows whose text or
    language is null, or whose text has no letter, aren't used. Without rows the
    model knows no language.
    """
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(max_rows // clusters).collect()}
    if not counts:
        e = np.zeros((0, dims), np.float32)
        return LanguageModel([], np.ones(dims, np.float32), e, np.zeros(0, int), np.zeros(0, np.float32), dims)
    quota = max(clusters, min(per_lang, max_rows // len(counts)))
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col(lang_col) == lang, F.lit(min(1.0, quota / n))).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.lit("lang"), F.col(id_col)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    schema = pa.schema([("lang", pa.string()), ("at", pa.binary()), ("n", pa.binary())])

    def vectors(batches):
        for b in batches:
            out = []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if LETTER.search(text):
                    c = ngram_counts(text, dims)
                    at = np.flatnonzero(c)
                    out.append((lang, at.astype(np.uint16).tobytes(), c[at].astype(np.uint32).tobytes()))
            yield batch_of(schema, list(zip(*out, strict=True)) or [[], [], []])

    got = rows.where(draw < rate).select(lang_col, text_col).mapInArrow(vectors, "lang string, at binary, n binary").collect()
    got = sorted(got, key=lambda r: (r[0], bytes(r[1]), bytes(r[2])))
    langs = sorted({r[0] for r in got})
    seen = np.zeros(dims, np.int64)
    for r in got:
        seen[np.frombuffer(r[1], np.uint16)] += 1
    idf = (np.log((1 + len(got)) / (1 + seen)) + 1).astype(np.float32)
    parts, owner, floor = [], [], []
    for k, lang in enumerate(langs):
        own = [r for r in got if r[0] == lang]
        c = np.zeros((len(own), dims), np.float32)
        for row, r in zip(c, own, strict=True):
            row[np.frombuffer(r[1], np.uint16)] = np.frombuffer(r[2], np.uint32)
        x = weighted(c, idf)
        centres = _clusters(x, clusters)
        best = x @ centres.T
        mine = best.argmax(1)
        for i, centre in enumerate(centres):
            near = best[mine == i, i]
            parts.append(centre)
            owner.append(k)
            # as far as the farthest texts it was made of, and half as far again
            floor.append(1 - 1.5 * (1 - near.min()) if len(near) else 1.0)
    return LanguageModel(langs, idf, np.stack(parts).astype(np.float32), np.array(owner), np.array(floor, np.float32), dims)


def detect(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang (``und`` without letters or if rejected), nearest (``und`` only without letters), score, rejected.

    Only the id and the text are read; other columns may have any name. A null,
    empty or letterless text is ``und`` with score 0. Repeated rows give repeated
    results. Of equally near languages the first in name order wins. Very long
    texts are counted in blocks, whole.
    """
    schema = pa.schema([("lang", pa.string()), ("nearest", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches):
        for part in slices(batches, _ROWS):
            texts = part.column(1).to_pylist()
            some = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
            near, score, out = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if some and model.langs:
                x = weighted(np.stack([ngram_counts(texts[i], model.dims) for i in some]), model.idf)
                cos = x @ model.centroids.T
                best = cos.argmax(1)
                value = cos[np.arange(len(some)), best]
                for i, c in zip(some, best, strict=True):
                    near[i] = model.langs[model.owner[c]]
                score[some] = np.clip(value, 0.0, 1.0)
                out[some] = value < model.floor[best]
            lang = ["und" if r else n for n, r in zip(near, out, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip((lang, near, score, out), schema, strict=True))], names=[id_col, *schema.names])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang string, nearest string, score double, rejected boolean")
