"""Quality classifier: hashed word and character n-gram vectors, averaged, with a softmax on top.

A word's features are itself, its bigram with the word before, and the 3- and
4-grams of its characters between boundary marks, hashed into buckets that each
have a learned vector. A bigram's hash is that of the difference of its words'
hashes, so that all words that repeat share what is learned of repeating. A word is
the mean of its features, a document the mean of its words. Vectors and output
weights are trained together by stochastic gradient descent in numpy, on a
bounded number of labelled documents, whose whole texts are reduced to weights of
buckets where they are read. Averages and output are linear, so scoring needs one
number for each bucket: its vector's part in the difference of the two outputs. A
batch is scored with array operations over its code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.bpe import chunks_of
from peakloom.llm.shared import text_of

GRAMS = (3, 4)
#: Buckets of features; a power of two.
BUCKETS = 1 << 15
_BLANK = np.uint32(0x20)
#: A training document: its buckets, and the weight of each in the document's mean.
Bag = tuple[np.ndarray, np.ndarray]


@dataclass
class QualityModel:
    """vectors: bucket x dimension; output: dimension x 2; bias: 2."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def collapsed(self) -> tuple[np.ndarray, float]:
        """Each bucket's part in log-odds of label 1, and their offset."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def _mixed(h: np.ndarray, buckets: int) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x2C1B3C6D)
    h = h ^ (h >> np.uint32(12))
    return (h * np.uint32(0x297A2D39)) >> np.uint32(32 - int(buckets).bit_length() + 1)


def _points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts that lie behind one another, and the texts' offsets among them."""
    upto = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), upto[offsets]


def features(points: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Where words start, each word's text, [(bucket, whether there is a feature)] by position, the words' own buckets, and (bucket, whether there is one) of their bigrams.

    Positions are those of a stream of code points in which all white space is blank and a blank stands before,
    between and after the texts. A gram belongs to the word of its second character and has blanks at its ends at
    most. buckets is a power of two.
    """
    n, texts = len(points), len(offsets) - 1
    stream = np.full(n + texts + 1, _BLANK, np.uint32)
    of_text = np.repeat(np.arange(texts), np.diff(offsets))
    stream[np.arange(n) + of_text + 1] = np.where((points >= 9) & (points <= 13), _BLANK, points)
    ink = stream != _BLANK
    starts = np.flatnonzero(ink[1:] & ~ink[:-1]) + 1
    text = np.searchsorted(offsets + np.arange(texts + 1), starts - 1, "right") - 1
    grams = []
    with np.errstate(over="ignore"):
        for g in GRAMS:
            m = max(0, len(stream) - g + 1)
            h = np.full(m, np.uint32(g * 0x9E37), np.uint32)
            ok = np.ones(m, bool)
            for k in range(g):
                h *= np.uint32(0x01000193)
                h += stream[k : k + m]
                if 0 < k < g - 1:
                    ok &= ink[k : k + m]
            grams.append((_mixed(h, buckets), ok))
        if not len(starts):
            return starts, text, grams, starts.astype(np.uint32), (starts.astype(np.uint32), starts > 0)
        power = np.multiply.accumulate(np.full(64, 0x01000193, np.uint32))
        place = np.zeros(len(stream), np.int32)
        place[starts] = starts
        inside = np.arange(len(stream), dtype=np.int32) - np.maximum.accumulate(place)
        value = (stream + np.uint32(1)) * power[inside & 63] + (inside >> 6).astype(np.uint32)
        value *= ink
        own = np.add.reduceat(value, starts, dtype=np.uint32)
        pair = _mixed((own - np.roll(own, 1)) * np.uint32(0xC2B2AE35) + np.uint32(11), buckets)
        return starts, text, grams, _mixed(own * np.uint32(0x85EBCA6B) + np.uint32(7), buckets), (pair, np.append(False, text[1:] == text[:-1]))


def log_odds(data: np.ndarray, offsets: np.ndarray, value: np.ndarray, bias: float) -> np.ndarray:
    """Log-odds of label 1 of each text: the mean over its words of the mean over their features, and the bias."""
    points, offsets = _points(data, offsets)
    n = len(offsets) - 1
    starts, text, grams, own, (pair, paired) = features(points, offsets, len(value))
    if not len(starts):
        return np.full(n, bias)
    size = len(points) + n + 1
    total, count = np.zeros(size, np.float32), np.zeros(size, np.float32)
    for bucket, ok in grams:
        total[1 : len(ok) + 1] += value[bucket] * ok
        count[1 : len(ok) + 1] += ok
    means = (np.add.reduceat(total, starts) + value[own] + value[pair] * paired) / (np.add.reduceat(count, starts) + 1 + paired)
    return np.bincount(text, means, n) / np.maximum(1, np.bincount(text, minlength=n)) + bias


def bags(data: np.ndarray, offsets: np.ndarray, buckets: int) -> list[Bag]:
    """Of each text its buckets and the weight of each in the text's mean."""
    points, offsets = _points(data, offsets)
    starts, text, grams, own, (pair, paired) = features(points, offsets, buckets)
    words = np.bincount(text, minlength=len(offsets) - 1)
    spots = [np.flatnonzero(ok & (len(starts) > 0)) for _, ok in grams]
    owner = np.concatenate([np.searchsorted(starts, at + 1, "right") - 1 for at in spots] + [np.arange(len(starts)), np.flatnonzero(paired)])
    bucket = np.concatenate([b[at] for (b, _), at in zip(grams, spots, strict=True)] + [own, pair[paired]]).astype(np.int64)
    weight = 1.0 / (np.bincount(owner, minlength=len(starts))[owner] * words[text[owner]])
    used, back = np.unique(text[owner] * buckets + bucket, return_inverse=True)
    weight, upto = np.bincount(back, weight, len(used)), np.searchsorted(used, np.arange(len(offsets)) * buckets)
    return [(used[a:b] % buckets, weight[a:b]) for a, b in zip(upto[:-1], upto[1:], strict=True)]


def train(
    documents: list[Bag], labels: list[int], buckets: int = BUCKETS, dimension: int = 16, steps: int = 400, rate: float = 8.0,
    batch: int = 32, seed: int = 7,
) -> QualityModel:
    """Train on documents with labels 0 and 1, for about so many steps whatever their number; the same documents in the same order give the same model."""
    rng = np.random.default_rng(seed)
    model = QualityModel(rng.normal(0, 0.1, (buckets, dimension)), rng.normal(0, 0.1, (dimension, 2)), np.zeros(2))
    y = np.array(labels, np.int64)
    epochs = max(1, round(steps / -(-len(documents) // batch))) if documents else 0
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(documents))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            used, column = np.unique(np.concatenate([documents[i][0] for i in some]), return_inverse=True)
            row = np.repeat(np.arange(len(some)), [len(documents[i][0]) for i in some])
            share = np.zeros((len(some), len(used)))
            share[row, column] = np.concatenate([documents[i][1] for i in some])
            mean = share @ model.vectors[used]
            z = mean @ model.output + model.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            pull = share.T @ (p @ model.output.T)
            model.output -= step * (mean.T @ p)
            model.bias -= step * p.sum(axis=0)
            model.vectors[used] -= step * pull
    return model


def labelled_bags(
    docs: DataFrame, labels: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_docs: int = 2500, buckets: int = BUCKETS,
) -> tuple[list[Bag], list[int]]:
    """The bags and labels of the sample, in the order of their ids.

    Bags travel as bytes, eight for each bucket that a document has.

    The sample_docs labelled ids that hash lowest make it; that is the bound. Their whole texts become bags in the
    tasks that read them, and only bags, of at most `buckets` entries each, reach the driver. An id with several
    labels counts by the largest, and of several texts by the longest bag.
    """
    known = labels.where(where & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(sample_docs)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks_of(batch.column(2)):
                found = bags(data, offsets, buckets)
                sides = [pa.array([b[k].astype(kind).tobytes() for b in found], pa.binary()) for k, kind in ((0, "<i4"), (1, "<f4"))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *sides], ["id", "y", "used", "weight"])

    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("t")).join(F.broadcast(sample), "id").select("id", "y", "t")
    rows = texts.mapInArrow(made, f"id {id_type}, y int, used binary, weight binary")
    rows = rows.groupBy("id").agg(F.max("y").alias("y"), F.max(F.struct(F.octet_length("used").alias("n"), "used", "weight")).alias("b")).collect()
    rows.sort(key=lambda r: r["id"])
    return [(np.frombuffer(r["b"]["used"], "<i4"), np.frombuffer(r["b"]["weight"], "<f4")) for r in rows], [r["y"] for r in rows]


def fit(docs: DataFrame, labels: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = 2500, **training) -> QualityModel | None:
    """Learn from a bounded sample of the labelled rows that fulfil `where`, see labelled_bags; None if there are none."""
    found, y = labelled_bags(docs, labels, where, id_col, text_col, label_col, sample_docs, training.get("buckets", BUCKETS))
    return train(found, y, **training) if found else None


def score(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1, higher: label 1 is likelier), predicted (1 from 0.5 on).

    A null or empty text, or one without a word, gets the score of the bias alone; without a model every score is
    0.5. Texts of any length are scored whole.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    value, bias = model.collapsed() if model is not None else (np.zeros(2, np.float32), 0.0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in chunks_of(batch.column(1)):
                odds = np.clip(log_odds(data, offsets, value, bias), -500, 500)
                p = 1 / (1 + np.exp(-odds))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(id_col, docs[text_col].cast("string").alias("__text")).mapInArrow(rows, f"`{id_col}` {id_type}, score double, predicted int")
