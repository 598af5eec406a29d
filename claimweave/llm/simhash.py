"""SimHash near-duplicates: exact tiled comparison of 64-bit fingerprints.

Each text becomes one fingerprint.  Distinct fingerprints are sorted into cells
by the numbers of set bits in their three blocks (22, 21 and 21 bits).  Two
fingerprints at most ``radius`` bits apart have block counts that differ by at
most ``radius`` in all, so every other pair of cells is skipped and the rest is
compared by exclusive-or and bit counts in numpy tiles.  A tile passes on only a
spanning forest of its links: that keeps every connection, and a group of m
near copies costs m rows, not m squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat
from operator import getitem

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .components import components, forest
from .store import input_table, unused, written

WIDTH = 3
SEED = 42
RADIUS = 2
#: Fingerprints of one cell that a task holds at most, and visitors to them.
TILE, VISITORS = 8192, 65536
#: Fingerprints compared at a time; all of them may be alike, and their pairs take some 25 MB then.
ROWS, COLUMNS = 128, 2048
#: The first bit and the number of bits of each block.
BLOCKS = ((0, 22), (22, 21), (43, 21))


def fingerprints(texts: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The SimHash of each text (uint64); zero for a text without words."""
    w = textbuf.Words(texts, textbuf.NON_SPACE)
    out = np.zeros(len(texts), np.uint64)
    if not len(w.starts):
        return out
    # Words with one space after each, so that a shingle is one slice.
    sizes = w.ends - w.starts
    at = np.concatenate(([0], np.cumsum(sizes + 1)))
    inside = textbuf.NON_SPACE[w.bytes]
    keep = inside.copy()
    keep[w.ends] = True
    flat = np.where(inside, w.bytes, 0x20)[keep].tobytes()
    per = np.where(w.counts > 0, np.maximum(w.counts - width + 1, 1), 0)
    first = np.repeat(w.first[:-1] - np.concatenate(([0], np.cumsum(per)[:-1])), per) + np.arange(per.sum())
    last = np.minimum(first + width, np.repeat(w.first[1:], per)) - 1
    cuts = map(slice, at[first].tolist(), (at[last] + sizes[last]).tolist())
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(getitem, repeat(flat), cuts), repeat(SEED)), np.uint64, len(first))
    some = np.flatnonzero(per)
    begin = (np.cumsum(per) - per)[some]
    ones = np.empty((len(some), 64), np.int64)
    # Bits as bytes, summed over each text's shingles.
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    np.add.reduceat(bits, begin, axis=0, dtype=np.int64, out=ones)
    major = (2 * ones > per[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = textbuf.texts_of(batch.column(1))
        for i, j in textbuf.blocks(texts, textbuf.BLOCK // 2):
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(fingerprints(texts[i:j]).view(np.int64))], ["doc_id", "fp"])
        textbuf.give_back()


def _links_in_tile(home: np.ndarray, visit: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``home`` and between it and ``visit``."""
    all_ = np.concatenate((home, visit))
    root = np.arange(len(all_))
    for i in range(0, len(home), ROWS):
        for j in range(i, len(all_), COLUMNS):
            near = np.bitwise_count(home[i : i + ROWS, None] ^ all_[None, j : j + COLUMNS]) <= radius
            if near.any():
                # What is connected already, in a large group nearly all, needs no pairs.
                near &= root[i : i + ROWS, None][: len(near)] != root[None, j : j + COLUMNS]
                a, b = np.nonzero(near)
                root = forest(len(all_), a + i, b + j, root)
    linked = np.flatnonzero(root != np.arange(len(all_)))
    return all_[linked], all_[root[linked]]


def _cell(fp) -> list:
    return [F.bit_count(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << size) - 1).cast("long"))) for at, size in BLOCKS]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links a-b, whose components are those of all pairs of ``distinct.fp`` within ``radius`` bits."""
    counts = _cell(F.col("fp"))
    cells = distinct.select("fp", (counts[0] * 1024 + counts[1] * 32 + counts[2]).alias("cell"))
    # At most 23 * 22 * 22 rows whatever the input, so the plan of tiles fits the driver and a broadcast.
    sizes = {r.cell: r.n for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    steps = sorted(d[0] * 1024 + d[1] * 32 + d[2] for d in product(range(-radius, radius + 1), repeat=3) if (0, 0, 0) < d and sum(map(abs, d)) <= radius)
    plan = [(c, -(-n // TILE), -(-(n + sum(sizes.get(c - s, 0) for s in steps)) // VISITORS)) for c, n in sizes.items()]
    planned = F.broadcast(distinct.sparkSession.createDataFrame(plan, "target int, tiles int, shares int"))
    salt = F.xxhash64("fp", F.lit(7))
    sent = (
        cells.select("fp", "cell", F.explode(F.array(F.lit(0), *(F.lit(s) for s in steps))).alias("step"))
        .withColumn("target", F.col("cell") + F.col("step")).join(planned, "target")
        .withColumn("own", F.when(F.col("step") == 0, F.pmod(salt, F.col("tiles")).cast("int")))
        .withColumn("tile", F.explode(F.sequence(F.lit(0), F.coalesce("own", F.col("tiles") - 1))))
        .withColumn("home", F.coalesce(F.col("tile") == F.col("own"), F.lit(False)))
        .withColumn("share", F.explode(F.when(F.col("home"), F.sequence(F.lit(0), F.col("shares") - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp", F.lit(11)), F.col("shares")).cast("int")))))
        .select("target", "tile", "share", "home", "fp")
    )

    def compared(t: pa.Table) -> pa.Table:
        home = t.column("home").to_numpy()
        fp = t.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        a, b = _links_in_tile(np.sort(fp[home]), np.sort(fp[~home]), radius)
        textbuf.give_back()
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return sent.groupBy("target", "tile", "share").applyInArrow(compared, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs`` (which needs doc_id and text).

    Null and empty texts and texts of white space have fingerprint zero and are
    linked like any other.  Repeated rows stay, each with the same component.  A
    null doc_id takes part, but cannot be a component's smallest id unless all
    are null.  An empty table gives an empty result; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    table, _ = written(docs.select("doc_id", "text").mapInArrow(_fingerprint_batches, f"doc_id {kind}, fp long"), "fingerprints")
    distinct = table.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return table.join(placed.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row for each component: that of the smallest doc_id, columns unchanged.

    Rows that share a doc_id are taken as repeats of one document, of which one
    stays.  Nothing says which row of a component to keep by a null doc_id: such
    rows stay, those with equal texts once.
    """
    return firsts(docs, near_duplicates(docs, radius))


def firsts(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``one_of_each`` keeps, by ``doc_id, component_id``."""
    none = F.lit(-(1 << 63)).cast("long")
    at, text = unused(docs, "_at"), unused(docs, "_hash")
    found = placed.where("doc_id is null or doc_id = component_id")
    kept = docs.withColumns({at: F.coalesce("doc_id", none), text: F.when(F.col("doc_id").isNull(), F.xxhash64("text"))})
    kept = kept.join(found.select(F.coalesce("doc_id", none).alias(at)).distinct(), at, "left_semi")
    return kept.dropDuplicates([at, text]).drop(at, text)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """The query: every document's fingerprint and component."""
    found = near_duplicates(input_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
