"""A quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of 256 that overlap by the width of a
filter, so that every byte and every window of the whole text is seen.  Learned
filters over eight bytes slide over each chunk; what each gives at its strongest
place, but zero at least, is the chunk's value (max-pooling).  The mean and the
maximum of the chunks' values, weighted by a learned layer, give one probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .labelled import held_out, sample
from .store import input_table

WIDTH, FILTERS, CHUNK = 8, 24, 256
STEP = CHUNK - WIDTH + 1
#: Bounds of the sample that the network is fitted on: rows of each label, and bytes of a row.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 16_384
EPOCHS, BATCH, RATE = 16, 32, 0.006
THRESHOLD = 0.3


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All chunks as rows of bytes, zero beyond the text, and where each text's begin; a text has one at least."""
    n = np.array([max(1, -(-max(0, len(t) - WIDTH + 1) // STEP)) for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(n)))
    room = np.zeros(int(n.sum()) * STEP + CHUNK, np.uint8)
    out = np.zeros((int(first[-1]), CHUNK), np.uint8)
    for i, t in enumerate(texts):
        size = int(n[i]) * STEP + CHUNK - STEP
        room[: len(t)] = np.frombuffer(t, np.uint8)
        room[len(t) : size] = 0
        out[first[i] : first[i + 1]] = np.lib.stride_tricks.sliding_window_view(room[:size], CHUNK)[::STEP][: n[i]]
    return out, first


class Network:
    """Filters (width x byte x filter), their biases, and the output layer."""

    def __init__(self, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        self.filters = r.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, 0.2, 2 * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)

    def pairs(self) -> list[np.ndarray]:
        """Tables from two neighbouring bytes to what they add to each filter."""
        return [(self.filters[j][:, None, :] + self.filters[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]

    def pooled(self, rows: np.ndarray, tables: list[np.ndarray], where: bool = False):
        """Each chunk's value of each filter, and on demand the place of its maximum."""
        best = np.empty((len(rows), FILTERS), np.float32)
        place = np.empty((len(rows), FILTERS), np.int64) if where else None
        for i in range(0, len(rows), 128):
            b = rows[i : i + 128].astype(np.int32)
            two = (b[:, :-1] << 8) | b[:, 1:]
            total = tables[0].take(two[:, 0:STEP], axis=0)
            for k in range(1, WIDTH // 2):
                total += tables[k].take(two[:, 2 * k : 2 * k + STEP], axis=0)
            if where:
                place[i : i + 128] = total.argmax(1)
            best[i : i + 128] = total.max(1)
        return best + self.bias, place

    def logits(self, values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = np.maximum(values, 0)
        n = np.diff(first)[:, None]
        features = np.hstack((np.add.reduceat(v, first[:-1], axis=0) / n, np.maximum.reduceat(v, first[:-1], axis=0)))
        return features @ self.out + self.shift[0], features

    def scores(self, texts: list[bytes], tables: list[np.ndarray] | None = None) -> np.ndarray:
        """The probability of label 1 for each text; an empty text is scored as one chunk of zeros."""
        if not texts:
            return np.zeros(0)
        rows, first = chunks(texts)
        z = self.logits(self.pooled(rows, tables or self.pairs())[0], first)[0].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def fit(self, texts: list[bytes], labels: list[int], prior: float) -> Network:
        """Learn from labelled texts, both labels weighing the same; then shift to the share ``prior`` of label 1."""
        if len(set(labels)) < 2:
            self.out[:] = 0
            self.shift[:] = _logit(prior)
            return self
        y = np.array(labels, np.float64)
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        r = np.random.default_rng(17)
        state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (self.filters, self.bias, self.out, self.shift)]
        t = 0
        for _ in range(EPOCHS):
            order = r.permutation(len(texts))
            for k in range(0, len(order), BATCH):
                some = order[k : k + BATCH]
                rows, first = chunks([texts[i] for i in some])
                values, place = self.pooled(rows, self.pairs(), True)
                z, features = self.logits(values, first)
                error = (weight[some] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)).astype(np.float32)
                g_out = features.T @ error + 1e-4 * self.out
                v = np.maximum(values, 0)
                n = np.diff(first)
                top = np.repeat(features[:, FILTERS:], n, axis=0)
                g = np.repeat(error, n)[:, None] * (self.out[:FILTERS] / np.repeat(n, n)[:, None] + self.out[FILTERS:] * (v == top))
                g = (g * (values > 0)).astype(np.float32)
                g_filters = np.zeros_like(self.filters)
                which = np.arange(FILTERS)
                for j in range(WIDTH):
                    byte = rows[np.arange(len(rows))[:, None], place + j]
                    np.add.at(g_filters[j], (byte, which[None, :]), g)
                t += 1
                for (p, m, s), d in zip(state, (g_filters, g.sum(0), g_out, np.array([error.sum()], np.float32)), strict=True):
                    m += 0.1 * (d - m)
                    s += 0.01 * (d * d - s)
                    p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-6)
        self.shift += np.float32(_logit(prior))
        return self


def _logit(p: float) -> float:
    p = min(max(p, 1e-3), 1 - 1e-3)
    return float(np.log(p / (1 - p)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Network:
    """A network fitted on a bounded sample; without labels of both kinds it gives the known share to all."""
    texts, y, share = sample(docs, labels, label, SAMPLE_ROWS, SAMPLE_BYTES)
    return Network().fit([t.encode() for t in texts], y, share)


def scored(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` with a column ``score`` (a column of that name is replaced).

    Null and empty texts are scored as a chunk of zero bytes; equal texts have
    equal scores; an empty table gives an empty result.
    """
    others = [c for c in docs.columns if c.lower() != "score"]
    schema = docs.select(*(docs[c] for c in others)).schema.add("score", "double")
    place = others.index("text")
    parts = (network.filters, network.bias, network.out, network.shift)

    def run(batches):
        net = Network.__new__(Network)
        net.filters, net.bias, net.out, net.shift = parts
        tables = net.pairs()
        for batch in batches:
            texts = textbuf.texts_of(batch.column(place))
            for i, j in textbuf.blocks(texts):
                yield pa.RecordBatch.from_arrays([*(c[i:j] for c in batch.columns), pa.array(net.scores(texts[i:j], tables))], schema.names)
            textbuf.give_back()

    return docs.select(*(docs[c] for c in others)).mapInArrow(run, schema)


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, columns unchanged."""
    columns = docs.columns
    frame = docs if "score" not in [c.lower() for c in columns] else docs.withColumnRenamed("score", "_score")
    kept = scored(frame, train(docs, labels)).where(F.col("score") >= THRESHOLD).drop("score")
    return kept.toDF(*columns)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """The query: every document's score and prediction."""
    docs = input_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, train(docs, input_table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
