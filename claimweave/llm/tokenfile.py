"""Token ids of a corpus as binary shards, written and read in parallel.

A shard holds the documents of one range of doc_id in ascending order, as
segments.  A segment is the mark ``TOKS``, the little-endian 64-bit sizes of its
three parts, their crc32, and the parts:

1. its documents: a byte that says which have an id, the ids, the counts of
   token ids (zlib, little-endian 64-bit);
2. the sizes of its blocks (zlib, little-endian 32-bit);
3. the blocks, each coded and checksummed by itself (see ``rangecoder``).

Blocks run across documents.  A task writes its shard under a name of its own
and reports it only when the file is whole; the manifest, a table that Spark
commits, names the shards that count, so files of lost or repeated tasks are
never read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import default_path, text_blocks, vocabulary
from .rangecoder import LANES, SIZE, decode_blocks, encode_blocks
from .store import input_table, new_path, written

#: Ids gathered for a segment, unless one document has more: as many blocks as are coded side by side.
SEGMENT = LANES * SIZE
END = 2
_MARK = b"TOKS"


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder; Hadoop's names for S3 are understood."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", folder))


def _segment(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    blocks = encode_blocks(ids)
    has = np.array([i is not None for i in doc_ids], np.uint8)
    known = np.array([0 if i is None else i for i in doc_ids], "<i8")
    parts = [zlib.compress(has.tobytes() + known.tobytes() + counts.astype("<i8").tobytes()), zlib.compress(np.array([len(b) for b in blocks], "<u4").tobytes()), b"".join(blocks)]
    return b"".join([_MARK, *(len(p).to_bytes(8, "little") for p in parts), *(zlib.crc32(p).to_bytes(4, "little") for p in parts[:2]), *parts])


def _segments(f) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Doc ids, counts and token ids of each segment of an open shard."""
    while head := f.read(4 + 24 + 8):
        if head[:4] != _MARK or len(head) < 36:
            raise ValueError("this is no segment")
        sizes = [int.from_bytes(head[4 + 8 * k : 12 + 8 * k], "little") for k in range(3)]
        docs, lengths, code = (f.read(n) for n in sizes)
        for k, part in enumerate((docs, lengths)):
            if zlib.crc32(part) != int.from_bytes(head[28 + 4 * k : 32 + 4 * k], "little"):
                raise ValueError("a segment's index is damaged")
        docs = zlib.decompress(docs)
        n = len(docs) // 17
        has = np.frombuffer(docs, np.uint8, n)
        known, counts = np.frombuffer(docs, "<i8", 2 * n, n).reshape(2, n)
        ends = np.cumsum(np.frombuffer(zlib.decompress(lengths), "<u4").astype(np.int64)).tolist()
        blocks = decode_blocks([code[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        yield [i if h else None for h, i in zip(has.tolist(), known.tolist(), strict=True)], counts, np.concatenate([np.zeros(0, np.int32), *blocks])


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> DataFrame:
    """Encode ``docs`` and write the shards; the manifest: ``shard, file, n_docs, n_ids``.

    Documents stand in ascending doc_id order, null ids first, those of equal
    ids by the hash of their text.  Null and empty texts hold just the end id.
    An empty table writes no shard.
    """
    path = path or default_path()
    store, at = _store(folder)
    store.create_dir(at, recursive=True)

    def run(batches):
        v = vocabulary(path)
        store, at = _store(folder)
        name = f"{uuid.uuid4().hex}.toks"
        out, n_docs, n_ids = None, 0, 0
        names, counts, parts, size = [], [], [], 0

        def flush():
            nonlocal out, names, counts, parts, size
            out = out or store.open_output_stream(f"{at}/{name}")
            out.write(_segment(names, np.concatenate(counts), np.concatenate(parts)))
            names, counts, parts, size = [], [], [], 0

        for batch in batches:
            for i, j, texts in text_blocks(batch.column(1)):
                ids, first = v.encode(texts)
                parts.append(np.insert(ids, first[1:], end))
                counts.append(np.diff(first) + 1)
                names += batch.column(0)[i:j].to_pylist()
                size += len(parts[-1])
                n_docs, n_ids = n_docs + j - i, n_ids + len(parts[-1])
                if size >= SEGMENT:
                    flush()
        if size:
            flush()
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "file": [name], "n_docs": [n_docs], "n_ids": [n_ids]})

    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(ranged.mapInArrow(run, "shard long, file string, n_docs long, n_ids long"), "manifest")[0]


def read_tokens(manifest: DataFrame, folder: str, digest=None, columns: str = "ids array<int>") -> DataFrame:
    """``doc_id, start, n_tokens`` and the ids of every document, in order of the shards.

    ``digest`` maps the ids of one document to the value of ``columns`` instead
    of the ids themselves.
    """
    starts = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    schema = f"doc_id long, start long, n_tokens long, {columns}"

    def run(batches):
        store, at = _store(folder)
        types = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("v", pa.int64() if digest else pa.list_(pa.int32()))])
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{at}/{name}") as f:
                    for doc_ids, counts, ids in _segments(f):
                        cuts = np.concatenate(([0], np.cumsum(counts)))
                        values = (digest(ids[a:b]) if digest else ids[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False))
                        for k in range(0, len(doc_ids), 20_000):
                            n = len(doc_ids[k : k + 20_000])
                            yield pa.RecordBatch.from_arrays([pa.array(doc_ids[k : k + n], pa.int64()), pa.array(start + cuts[k : k + n]), pa.array(counts[k : k + n]), pa.array([next(values) for _ in range(n)], types.field(3).type)], names=[*types.names[:3], columns.split()[0]])
                        start += int(cuts[-1])

    shards = max(1, manifest.count())
    return starts.select("file", "start", "shard").repartitionByRange(shards, "shard").select("file", "start").mapInArrow(run, schema)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4"))


def op4_token_file(spark, sf_dir: str) -> DataFrame:
    """The query: every document's place, count and checksum, from the files read back."""
    folder = new_path(spark, "tokens")
    manifest = write_tokens(input_table(spark, sf_dir, "documents"), folder)
    return read_tokens(manifest, folder, _crc, "ids_crc32 long")
