"""Toxicity by multiple-instance learning.

Only documents carry labels, while what offends stands in sentences.  A sentence
has a probability from the weights of its words and of the words' beginnings (of
five to eight bytes, which catches inflected and compound words); a document is toxic if any
sentence is, so its probability is the noisy-or of its sentences'.  Training
follows the documents' labels through the noisy-or to the words, and the trained
sentence scores say where the offence stands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .labelled import held_out, sample
from .store import input_table

#: Word weights (hashed), and words of a sentence at most: longer ones go on as the next sentence.
SLOTS, LONGEST = 1 << 18, 64
#: Bounds of the sample that is learnt from: rows of each label, and bytes of a row.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 32_768
#: A word or beginning gets a weight if its toxic documents in the sample are so many standard deviations above chance.
DEVIATIONS = 6.0
EPOCHS, RATE, DECAY = 200, 0.1, 1e-5
#: Bytes of the beginnings of words that have weights of their own.
BEGINNINGS = (5, 6, 7, 8)
THRESHOLD, OFFENDING = 0.5, 0.5
_ENDS = textbuf.byte_class(lambda b: chr(b) in ".!?\n")


class Sentences:
    """The sentences of a block of texts, as ranges of words."""

    def __init__(self, texts: list[bytes]) -> None:
        w = textbuf.Words(texts, textbuf.WORD)
        self.words = w
        sums = textbuf.prefix(w.bytes)
        size = w.ends - w.starts
        #: For whole words and each length of beginning, a row of slots; slot 0 where a word is not longer.
        self.slots = np.stack([_slot(textbuf.slices(sums, w.starts, w.ends)), *(np.where(size > k, _slot(textbuf.slices(sums, w.starts, np.minimum(w.ends, w.starts + k)) ^ np.uint64(k)), 0) for k in BEGINNINGS)])
        ends = np.flatnonzero(_ENDS[w.bytes])
        part = np.searchsorted(ends, w.starts)
        text = w.text_of()
        fresh = np.append(True, (part[1:] != part[:-1]) | (text[1:] != text[:-1]))[: len(part)]
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, len(part)))
        more = -(-size // LONGEST)
        shift = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        #: The first word of each sentence, and its text.
        self.begin = np.repeat(begin, more) + shift * LONGEST
        self.text = text[self.begin] if len(self.begin) else np.zeros(0, np.int64)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """The sum of word weights in each sentence."""
        return np.add.reduceat(weights[self.slots].sum(0), self.begin) if len(self.begin) else np.zeros(0)

    def span(self, i: int) -> tuple[int, int]:
        """Where sentence ``i`` stands in its text, in bytes."""
        w = self.words
        last = (self.begin[i + 1] if i + 1 < len(self.begin) else len(w.starts)) - 1
        start = w.base[self.text[i]]
        return int(w.starts[self.begin[i]] - start), int(w.ends[last] - start)


def _slot(h: np.ndarray) -> np.ndarray:
    return 1 + (h % np.uint64(SLOTS - 1)).astype(np.int64)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


class Model:
    """Word weights and the bias of a sentence."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[int], prior: float) -> Model:
        """Learn word weights from documents' labels; the share ``prior`` of label 1 weighs the labels.

        With one label only, or none, no word has a weight.
        """
        if len(set(labels)) < 2:
            return cls(np.zeros(SLOTS, np.float32), -9.0)
        y = np.array(labels, np.float64)
        weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean())) ** 0.5
        weight /= weight.sum()
        # Twice over the texts in blocks, so that what is held at a time does not grow with the sample.
        has, toxic, share = np.zeros(SLOTS, np.int64), np.zeros(SLOTS), y.mean()
        parts = list(textbuf.blocks(texts))
        for i, j in parts:
            s = Sentences(texts[i:j])
            slot, doc = np.divmod(np.unique((s.slots * (j - i) + s.words.text_of()).ravel()), j - i)
            has += np.bincount(slot, minlength=SLOTS)
            toxic += np.bincount(slot, y[i + doc], minlength=SLOTS)
        known = toxic - has * share > DEVIATIONS * np.sqrt(np.maximum(has, 1) * share * (1 - share))
        known[0] = False
        # Weights of the known words only, in a short vector.
        number = np.cumsum(known) - 1
        slots, sentences, owners, count = [], [], [], 0
        for i, j in parts:
            s = Sentences(texts[i:j])
            use = known[s.slots]
            slots.append(number[s.slots[use]])
            sentence = count + np.repeat(np.arange(len(s.begin)), np.diff(np.append(s.begin, len(s.words.starts))))
            sentences.append(np.broadcast_to(sentence, s.slots.shape)[use])
            owners.append(i + s.text)
            count += len(s.begin)
        slot, sentence, owner = np.concatenate(slots), np.concatenate(sentences), np.concatenate(owners)
        del s, slots, sentences, owners
        textbuf.give_back()
        n = len(texts)
        theta, bias = np.zeros(int(known.sum())), -6.0
        m = np.zeros(len(theta) + 1)
        v = np.zeros(len(theta) + 1)
        for t in range(1, EPOCHS + 1):
            z = bias + np.bincount(sentence, theta[slot], minlength=count)
            total = np.bincount(owner, _softplus(z), minlength=n)
            none = np.exp(-total)
            # d loss / d total: for toxic documents -e^-total / (1 - e^-total), for others 1.
            slope = weight * np.where(y == 1, -none / np.maximum(1 - none, 1e-9), 1.0)
            d = slope[owner] / (1 + np.exp(-z))
            g = np.append(np.bincount(slot, d[sentence], minlength=len(theta)) + DECAY * theta, d.sum())
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
            theta -= step[:-1]
            bias -= step[-1]
        out = np.zeros(SLOTS, np.float32)
        out[known] = theta
        return cls(out, float(bias))

    def sentence_scores(self, s: Sentences) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(s.sums(self.weights) + self.bias, -60, 60)))

    def scores(self, s: Sentences, n: int) -> np.ndarray:
        """The noisy-or of each text's sentences; zero without words."""
        return 1 - np.exp(-np.bincount(s.text, _softplus(s.sums(self.weights) + self.bias), minlength=n))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """A model learnt from a bounded sample of labelled documents."""
    texts, y, share = sample(docs, labels, label, SAMPLE_ROWS, SAMPLE_BYTES)
    return Model.fit([t.encode() for t in texts], y, share)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, offending`` of each row: the offending sentences as (start, end, score), in bytes of UTF-8.

    Null and empty texts and texts without words score 0 and have no sentence.
    Equal texts have equal scores.  An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            texts = textbuf.texts_of(batch.column(1))
            for i, j in textbuf.blocks(texts):
                s = Sentences(texts[i:j])
                p = model.sentence_scores(s)
                found: list[list] = [[] for _ in range(j - i)]
                for k in np.flatnonzero(p >= OFFENDING).tolist():
                    a, b = s.span(k)
                    found[s.text[k]].append({"start": a, "end": b, "score": float(p[k])})
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(model.scores(s, j - i)), pa.array(found, spans)], ["doc_id", "score", "offending"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, offending array<struct<start:long,end:long,score:double>>")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """The query: every document's score, prediction, and how many sentences offend."""
    docs = input_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, train(docs, input_table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"))
