"""Near copies among documents by SimHash, and by MinHash over runs of five words for those further apart.

Words are what stands between white space, lower-cased.  Every document gets the
fingerprint of ``simhash`` (three-word shingles); fingerprints at most two bits apart
are linked by its popcount cells and tiled comparison.  Copies at Jaccard similarity 0.8
lie typically 3 to 11 of 64 bits apart, and a radius of that size bounds neither what is
missed nor the pairs to compare.  So a document also has the minimum of 64 hashes over
its runs of five words, cut into sixteen bands of four: documents with Jaccard similarity
0.8 meet in a band in all but 2 of 10,000 cases, and those that meet are compared by exact
Jaccard similarity.  Links of both kinds together become components by one distributed union-find.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash, textbuf
from .components import components
from .linededup import Lines, blobs, hash_family, lowered, similar_links
from .store import written

WIDTH = 5


class Documents(Lines):
    """The texts with words of a block, each as one line: its words with one space between them."""

    rows, n_bands, bin = 4, 16, 300
    multiply = hash_family(rows * n_bands)

    def __init__(self, texts: list[bytes]) -> None:
        self.words = w = textbuf.Words(texts, textbuf.NON_SPACE)
        inside = textbuf.NON_SPACE[w.bytes]
        keep = inside.copy()
        keep[w.ends] = True
        flat = np.where(inside, w.bytes, 0x20)[keep].astype(np.uint8).tobytes()
        at = np.concatenate(([0], np.cumsum(w.ends - w.starts + 1)))
        self.text = np.flatnonzero(w.counts)
        self.norms = [flat[a:b] for a, b in zip(at[w.first[self.text]].tolist(), (at[w.first[self.text + 1]] - 1).tolist(), strict=True)]

    @classmethod
    def again(cls, norms: list[bytes]) -> Documents:
        return cls(norms)

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of 40 bits of all texts' runs of words, and where each text's begin."""
        h, owner = self.words.shingles(WIDTH)
        return h >> np.uint64(24), np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(self.words.counts))[self.text])))


def _signed(batches):
    for batch in batches:
        texts = lowered(batch.column(1))
        for i, j in textbuf.blocks(texts, textbuf.BLOCK // 2):
            docs = Documents(texts[i:j])
            keys, bands = np.zeros(j - i, np.int64), np.zeros((j - i, docs.n_bands), np.int64)
            keys[docs.text], bands[docs.text] = docs.keys(), docs.bands()
            size = np.zeros(j - i, np.int32)
            size[docs.text] = docs.n_bands
            ends = np.concatenate(([0], np.cumsum(size)))
            prints = pa.array(simhash.fingerprints(texts[i:j]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(keys), prints, blobs(bands[docs.text], ends)], ["doc_id", "line", "fp", "bands"])
        textbuf.give_back()


def print_links(keyed: DataFrame, radius: int = simhash.RADIUS) -> DataFrame:
    """Links a-b between keys ``line`` whose fingerprints ``fp`` are at most ``radius`` bits apart.

    Keys of one fingerprint are linked with the smallest of them, which stands for it in all other links.
    """
    firsts, _ = written(keyed.groupBy("fp").agg(F.min("line").alias("first")), "prints")
    equal = keyed.join(firsts, "fp").where("line <> first").select(F.col("line").alias("a"), F.col("first").alias("b"))
    near = simhash.links(firsts.select("fp"), radius)
    one, other = (firsts.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first")) for c in ("a", "b"))
    return equal.unionByName(near.join(one, "a").join(other, "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b")))


def near_copies(docs: DataFrame, radius: int = simhash.RADIUS) -> DataFrame:
    """``doc_id, component_id`` for every row of ``docs`` (which needs doc_id and text).

    Linked are fingerprints at most ``radius`` bits apart and texts of Jaccard similarity 0.8.  Texts of equal words are copies, and so are all texts without words, null
    included.  A null doc_id takes part, but cannot be a component's smallest id
    unless all are null.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    table, _ = written(docs.select("doc_id", "text").mapInArrow(_signed, f"doc_id {kind}, line long, fp long, bands binary"), "documents", "zstd")
    distinct = table.groupBy("line").agg(F.min("doc_id").alias("least"))
    prints = print_links(table.select("line", "fp").distinct(), radius)
    signed = table.where("length(bands) > 0").dropDuplicates(["line"]).select("line", "bands")
    signed, _ = written(signed, "signed", "zstd")
    roots = components(similar_links(signed, docs, Documents).unionByName(prints)).withColumnRenamed("node", "line")
    placed = distinct.join(roots, "line", "left").withColumn("root", F.coalesce("root", "line"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return table.select("doc_id", "line").join(placed.join(ids, "root").select("line", "component_id"), "line").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each group of near copies, as ``simhash.one_of_each`` chooses it."""
    return simhash.firsts(docs, near_copies(docs))
