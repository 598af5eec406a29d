"""Benchmark decontamination by size-partitioned MinHash containment.

An item is found in a document if at least ``threshold`` of the item's distinct
shingles (runs of five words) stand in the document, wherever they stand.  Items
are put into partitions by their number of shingles, each twice as wide as the
one before.  Both sides are sketched for each partition: of an item with up to
``u`` shingles the ``k`` smallest hashes are kept, with k just above
(1 - threshold) * u; of a document all hashes up to the partition's limit, the
largest hash in any of its items' sketches.  A document that holds enough of an
item lacks at most k - 1 of its shingles, so it holds one of the k, and as that
one is within the limit, it stands in the document's sketch.  The search
therefore misses nothing, with about a third of the document's hashes.  Each
find is then verified: the item's shingles are counted word by word among the
document's, over both whole texts.

An item of fewer than five words is one shingle, its whole sequence.  With ``short``
it is found wherever that sequence stands, as the query and the pipeline do it;
without, only in a document that is nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .store import input_table, unused, written

WIDTH, THRESHOLD = 5, 0.8
#: Most shingles of items that are sent to every task (about 50 bytes each, with the items' words); more are joined by hash.
BROADCAST = 500_000


def _lowered(column: pa.Array) -> list[bytes]:
    return textbuf.texts_of(pc.utf8_lower(column))


def _item_shingles(batches):
    for batch in batches:
        words = textbuf.Words(_lowered(batch.column(1)), textbuf.WORD)
        h, owner = words.shingles(WIDTH)
        if len(h):
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))
            h, owner = h[new], owner[new]
            n = np.bincount(owner, minlength=batch.num_rows)
            upper = 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)
            keep = np.floor((1 - THRESHOLD) * upper + 1e-9).astype(np.int64) + 1
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), batch.column(2).take(pa.array(owner)), pa.array(h.view(np.int64)), pa.array(n[owner]), pa.array(upper[owner]), pa.array(place < keep[owner]), pa.array(np.minimum(words.counts, WIDTH)[owner])], ["item_id", "part", "h", "n", "upper", "sketch", "width"])


def _distinct(items: DataFrame) -> DataFrame:
    """``item_id, text, part`` of the items that have both, each text once."""
    return items.where("item_id is not null and text is not null").select("item_id", "text", F.xxhash64("text").alias("part")).dropDuplicates(["item_id", "part"])


def item_shingles(items: DataFrame) -> DataFrame:
    """From ``item_id, text, part``: ``item_id, part, h, n, upper, sketch, width``: the distinct shingles of each item, its count, its partition, whether the sketch has it, and its words.

    Items whose id or text is null and items without words have none.  Texts
    that share an id are items of their own, told apart by ``part``, the text's hash.
    """
    return items.mapInArrow(_item_shingles, "item_id long, part long, h long, n long, upper long, sketch boolean, width long")


def _shingles(texts: list[bytes], widths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of the texts' shingles, and of their runs of ``widths`` words for shorter items."""
    words = textbuf.Words(texts, textbuf.WORD)
    h, owner = words.shingles(WIDTH)
    if widths:
        more = [(h, owner), *map(words.sequences, widths)]
        h, owner = (np.concatenate(x) for x in zip(*more, strict=True))
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    return h, owner


def _words(text: bytes) -> list[bytes]:
    w = textbuf.Words([text], textbuf.WORD)
    data = w.bytes.tobytes()
    return [data[a:b] for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]


def _runs(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


class _Exact:
    """Counts an item's shingles among a document's by their words."""

    def __init__(self, text: bytes, short: bool) -> None:
        self.words, self.short = _words(text), short
        self.sets: dict[int, set] = {}

    def share(self, item: list[bytes]) -> float:
        width = min(len(item), WIDTH)
        if width < WIDTH and not self.short:
            return float(self.words == item)
        if width not in self.sets:
            self.sets[width] = _runs(self.words, width)
        wanted = _runs(item, width)
        return len(wanted & self.sets[width]) / len(wanted)


def _finds(exact: _Exact, items: Iterator[tuple[int, list[bytes]]]) -> dict[int, float]:
    """The best share of each item_id of which a text is contained."""
    best: dict[int, float] = {}
    for name, words in items:
        share = exact.share(words)
        if share >= THRESHOLD - 1e-9:
            best[name] = max(best.get(name, 0), share)
    return best


def _hits_with(table: pa.Table, texts_: pa.Table, widths: list[int]):
    """A function for mapInArrow: the items that each document contains."""
    of_part = {(i, p): _words(t) for i, p, t in zip(texts_["item_id"].to_pylist(), texts_["part"].to_pylist(), _lowered(texts_["text"].combine_chunks()), strict=True)}
    h = table["h"].to_numpy()
    order = np.argsort(h, kind="stable")
    h = h[order]
    parts, code = np.unique(np.stack((table["item_id"].to_numpy(), table["part"].to_numpy()))[:, order], axis=1, return_inverse=True)
    names, code = parts[0], code.ravel()
    size = np.zeros(len(names), np.int64)
    size[code] = table["n"].to_numpy()[order]
    partition, kept = table["upper"].to_numpy()[order], table["sketch"].to_numpy(zero_copy_only=False)[order]
    sketches = []
    for u in np.unique(partition).tolist():
        hashes = np.unique(h[kept & (partition == u)].view(np.uint64))
        mask = np.zeros(1 << 20, bool)
        mask[(hashes & np.uint64(len(mask) - 1)).astype(np.int64)] = True
        sketches.append((hashes[-1], hashes, mask))
    words_of = [of_part[k] for k in zip(*parts.tolist(), strict=True)]
    keys, first = np.unique(h, return_index=True)
    many = np.diff(np.append(first, len(h)))

    def met(got: np.ndarray) -> np.ndarray:
        """Places of the hashes that a document's sketch and an item's share."""
        out = []
        for limit, hashes, mask in sketches:
            near = np.flatnonzero(got <= limit)
            near = near[mask[(got[near] & np.uint64(len(mask) - 1)).astype(np.int64)]]
            out.append(near[np.isin(got[near], hashes)])
        return np.concatenate(out)

    def run(batches):
        for batch in batches:
            texts = _lowered(batch.column(1))
            for i, j in textbuf.blocks(texts):
                docs, found, share = [], [], []
                got, owner = _shingles(texts[i:j], widths)
                near = met(got)
                got = got.view(np.int64)
                for d in np.unique(owner[near]).tolist():
                    a, b = np.searchsorted(owner, [d, d + 1])
                    mine = np.unique(got[a:b])
                    at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                    at = at[keys[at] == mine]
                    spots = np.repeat(first[at], many[at]) + np.arange(many[at].sum()) - np.repeat(np.cumsum(many[at]) - many[at], many[at])
                    shared = np.bincount(code[spots], minlength=len(names))
                    enough = np.flatnonzero(shared >= THRESHOLD * size - 1e-9).tolist()
                    if not enough:
                        continue
                    best = _finds(_Exact(texts[i + d], bool(widths)), ((names[k], words_of[k]) for k in enough))
                    docs += [i + d] * len(best)
                    found += best.keys()
                    share += best.values()
                if docs:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs)), pa.array(found, pa.int64()), pa.array(share, pa.float64())], ["doc_id", "item_id", "containment"])

    return run


def _doc_shingles_with(widths: list[int]):
    """A function for mapInArrow: the distinct shingles of each document."""

    def run(batches):
        for batch in batches:
            texts = _lowered(batch.column(1))
            for i, j in textbuf.blocks(texts):
                h, owner = _shingles(texts[i:j], widths)
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))[: len(h)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + owner[new])), pa.array(h[new].view(np.int64))], ["key", "h"])

    return run


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", short: bool = False) -> DataFrame:
    """``key, item_id, containment`` of each document and test item that it contains.

    Of texts that share an item_id, the one that is contained most counts.

    Null and empty texts contain nothing; a null key stays null; repeated rows
    give repeated finds.  No items or no documents give an empty result.  With
    ``short``, items of fewer than five words are found within longer texts too.
    """
    whole, _ = written(_distinct(items), "items")
    shingles, _ = written(item_shingles(whole), "shingles")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, item_id long, containment double"
    count = shingles.count()
    if not count:
        return docs.sparkSession.createDataFrame([], schema)
    widths = sorted(r.width for r in shingles.where(F.col("width") < WIDTH).select("width").distinct().collect()) if short else []
    if count <= BROADCAST:
        table, words = shingles.toArrow(), whole.toArrow()
        return docs.select(docs[key].alias("doc_id"), "text").mapInArrow(_hits_with(table, words, widths), schema.replace(key, "doc_id", 1)).withColumnRenamed("doc_id", key)
    # Beyond that: join by hash.  The sketches choose the pairs, the whole shingle sets verify them.
    rows, _ = written(docs.select(F.expr("uuid()").alias("row"), docs[key].alias("_key"), "text"), "rows")
    mine, _ = written(rows.select("row", "text").mapInArrow(_doc_shingles_with(widths), "key string, h long"), "shingles")
    # The largest limit as a signed number of the same order: all document hashes beyond it are in no sketch.
    ordered = F.col("h").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    limit = shingles.where("sketch").agg(F.max(ordered)).first()[0]
    pairs = mine.where(ordered <= limit).join(shingles.where("sketch").select("item_id", "part", "h"), "h").select("key", "item_id", "part").distinct()
    shared = pairs.join(shingles, ["item_id", "part"]).join(mine, ["key", "h"]).groupBy("key", "item_id", "part", "n").agg(F.count("*").alias("shared"))
    near = shared.where(F.col("shared") >= THRESHOLD * F.col("n") - 1e-9).select("key", "item_id", "part")
    near = near.join(whole.select("item_id", "part", F.col("text").alias("item")), ["item_id", "part"]).join(rows.select(F.col("row").alias("key"), "_key", "text"), "key")

    def verified(batches):
        for batch in batches:
            out = []
            for text, item, name in zip(_lowered(batch.column(0)), _lowered(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                out.append(_finds(_Exact(text, bool(widths)), iter([(name, _words(item))])).get(name))
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(4), batch.column(2), pa.array(out, pa.float64())], ["key", "_key", "item_id", "containment"])

    kept = near.select("text", "item", "item_id", "key", "_key").mapInArrow(verified, f"key string, _key {kind}, item_id long, containment double").where("containment is not null")
    return kept.groupBy("key", "item_id").agg(F.first("_key").alias(key), F.max("containment").alias("containment")).select(key, "item_id", "containment")


def clean(docs: DataFrame, items: DataFrame, short: bool = False) -> DataFrame:
    """``docs`` without the rows whose text contains a test item; columns unchanged.

    Rows are told apart by the hash of doc_id and text, so of rows that share a
    doc_id, or have none, only those go whose own text contains an item.
    """
    at = unused(docs, "_at")
    named = docs.withColumn(at, F.xxhash64("doc_id", "text"))
    bad = contained(named.select(at, "text"), items, at, short).select(at).distinct()
    return named.join(bad, at, "left_anti").drop(at)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """The query: every find of a benchmark item in a document."""
    found = contained(input_table(spark, sf_dir, "documents"), input_table(spark, sf_dir, "benchmark"), short=True)
    return found.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))
