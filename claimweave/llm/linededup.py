"""Fuzzy line dedup by MinHash over character shingles.

Lines are compared lower-cased, with runs of white space as one space.  A line's
signature is the minimum of 60 hashes over its runs of five characters, cut into
twelve bands of five: lines with Jaccard similarity 0.8 meet in a band with
probability 0.991, with 0.9 in all but 2 of 100,000 cases.  Every group of lines that meet is compared by
exact Jaccard similarity of the shingle sets (pairs already connected need no
comparison), links become components by distributed union-find, and of each
component the first occurrence in the corpus stays.  A group too large for one
task is first compared with one of its lines, part by part; only what is unlike
that line is compared with the whole group.

Only keys and signatures are shuffled, and texts once to lose their lines.  Joins with
a table of one row for each key are hashed, so that the large side is not sorted,
and the at most ``FEW`` keys with more than one in ``FEW`` of all rows are broadcast.  A bitmap of constant size picks the
lines whose text is needed; an exact join follows it, so a full bitmap costs
time but never a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .components import components
from .store import input_table, made, remove, unused, written

SHINGLE, ROWS, BANDS, THRESHOLD = 5, 5, 12, 0.8
#: Lines of a group that one task compares with each other.
TILE = 1000
#: Rows of groups that a task compares at a time, about; more than one group may be among them.
BIN = 1500
#: Marks of a line's shingles, by which dissimilar pairs are told apart before their sets are compared.
MARKS = 4096
#: Bytes of groups that are compared at a time, so that their arrays fit a core's cache.
PART = 1 << 17
#: Pairs of a band and a line that one bucket of bands holds, about.
PAIRS = 1 << 18
#: Lines of a batch that stand in one band, above which they are not dealt with its bucket.
CROWD = 100
#: A key is hot if it has more than one in FEW of all rows; so there are fewer than FEW.
FEW = 1000
#: Bits of the bitmap: 16 MB, whatever the input.
BITS = 27


_ODD = np.uint64(0x9E3779B97F4A7C15)


def hash_family(n: int) -> np.ndarray:
    """Odd multipliers of ``n`` MinHashes; what they multiply is well mixed already."""
    return np.random.default_rng(77).integers(1 << 31, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def _wide(letters) -> np.ndarray:
    """Codes of shingles that not only ASCII characters make."""
    h = np.uint64(0)
    for x in letters:
        h = (h + x) * _ODD
    return textbuf.mix(h) >> np.uint64(25) | np.uint64(1 << 39)


class Lines:
    """The lines with words of a block of texts, normalised: ``norms``."""

    rows, n_bands, bin = ROWS, BANDS, BIN
    multiply = hash_family(ROWS * BANDS)

    def __init__(self, texts: list[bytes]) -> None:
        self.norms, text, position = [], [], []
        for i, t in enumerate(texts):
            for k, line in enumerate(t.split(b"\n")):
                if words := line.split():  # at ASCII white space, as NON_SPACE has it
                    self.norms.append(b" ".join(words))
                    text.append(i)
                    position.append(k)
        self.text, self.position = np.array(text, np.int64), np.array(position, np.int64)

    @classmethod
    def again(cls, norms: list[bytes]) -> Lines:
        """What was normalised before, for its shingles."""
        out = cls.__new__(cls)
        out.norms = norms
        return out

    def keys(self) -> np.ndarray:
        """A 64-bit key of each line's normalised bytes."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.norms), np.uint64, len(self.norms)).view(np.int64)

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes of 40 bits of all lines' character shingles, some of them more than once, and where each line's begin.

        ASCII characters are their own code; other shingles have a hash with the highest bit.
        A line of fewer characters is one shingle.
        """
        data = b"\n".join([*self.norms, b""])
        plain = data.isascii()
        c = np.frombuffer(data, np.uint8) if plain else np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        ends = np.flatnonzero(c == 0x0A)
        at = np.concatenate(([0], ends + 1))
        starts, size = at[:-1], np.diff(at) - 1
        near = np.append(c, np.zeros(8, c.dtype))
        h = np.ndarray(len(c), "<u8", near.astype(np.uint8), strides=(1,)) & np.uint64((1 << 8 * SHINGLE) - 1)
        if not plain:
            at_, touched = np.flatnonzero(c >= 0x80), np.zeros(len(c) + SHINGLE, bool)
            for k in range(SHINGLE):
                touched[at_ + k] = True
            wide = np.flatnonzero(touched[SHINGLE - 1 : -1])
            h[wide] = _wide(near[wide + k] for k in range(SHINGLE))
        # Where a window would run over the line's end, its last whole one stands again.
        some = size >= SHINGLE
        for k in range(SHINGLE):
            h[ends[some] - k] = h[ends[some] - SHINGLE]
        if not some.all():
            begin, size = starts[~some], size[~some]
            letters = [np.where(size > k, near[begin + k], 0).astype(np.uint64) for k in range(SHINGLE)]
            whole = sum(x << np.uint64(8 * k) for k, x in enumerate(letters))
            whole = np.where(np.max(letters, 0) < 0x80, whole, _wide(letters))
            for k in range(SHINGLE):
                there = size >= k
                h[begin[there] + k] = whole[there]
        return h, at

    def bands(self) -> np.ndarray:
        """One row of band keys for each line."""
        n = len(self.norms)
        if not n:
            return np.zeros((0, self.n_bands), np.int64)
        h, at = self.shingles()
        x = (textbuf.mix(h) >> np.uint64(32)).astype(np.uint32)
        least = np.empty((self.n_bands, self.rows, n), np.uint32)
        room, begin = np.empty_like(x), at[:-1]
        for m, out in zip(self.multiply, least.reshape(-1, n), strict=True):
            np.multiply(x, m, out=room)
            np.minimum.reduceat(room, begin, out=out)
        bands, salt = np.zeros((self.n_bands, n), np.uint64), np.arange(1, self.n_bands + 1, dtype=np.uint64)[:, None]
        for k in range(self.rows):
            bands = textbuf.mix(bands + least[:, k] + salt)
        return np.ascontiguousarray(bands.T).view(np.int64)


def lowered(column: pa.Array) -> list[bytes]:
    return textbuf.texts_of(pc.utf8_lower(column))


def blobs(longs: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of longs as bytes: the k-th from ``ends[k]`` to ``ends[k + 1]``."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(longs))])


def _longs(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = lowered(batch.column(2))
        for i, j in textbuf.blocks(texts, textbuf.BLOCK // 8):
            lines = Lines(texts[i:j])
            rows = pa.array(lines.text + i)
            bands = blobs(lines.bands(), np.arange(len(lines.text) + 1) * BANDS)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(lines.position), pa.array(lines.keys()), bands], ["row", "doc_id", "position", "line", "bands"])
        textbuf.give_back()


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of column ``k``; at most 2 ** BITS bits come to the driver."""
    bit = F.pmod(F.xxhash64("k"), F.lit(1 << BITS)) + 1  # the builtins count from 1
    rows = keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = np.zeros(1 << BITS - 3, np.uint8)
    for r in rows:
        start = (r.bucket - 1) * len(r.bits)
        out[start : start + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each long may be among the bitmap's keys."""
    h = np.fromiter(map(_long_hash, values.tolist()), np.uint64, len(values)) if len(values) < 64 else _long_hashes(values)
    at = (h % np.uint64(1 << BITS)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _long_hashes(values: np.ndarray) -> np.ndarray:
    """XXH64 with seed 42 of 8-byte values, as ``F.xxhash64`` has it for a long."""
    p = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]

    def turn(x, n):
        return x << np.uint64(n) | x >> np.uint64(64 - n)

    h = np.uint64(42 + 8) + p[4]
    h = h ^ turn(values.view(np.uint64) * p[1], 31) * p[0]
    h = turn(h, 27) * p[0] + p[3]
    h = (h ^ h >> np.uint64(33)) * p[1]
    h = (h ^ h >> np.uint64(29)) * p[2]
    return h ^ h >> np.uint64(32)


def _long_hash(value: int) -> int:
    return xxhash.xxh64_intdigest((value & (1 << 64) - 1).to_bytes(8, "little"), 42)


def _verified(t: pa.Table, kind: type[Lines] = Lines, star: bool = False) -> pa.Table:
    """Links within each group, or between two of its tiles: a spanning forest of the pairs that are similar.

    The table holds many groups, which are compared in parts of about ``PART`` bytes.
    With ``star`` every line is only compared with the first of its group, and the
    rows are (band, line, first), with null for the first where they are unlike.
    """
    t = t.sort_by([("lead", "ascending"), ("band", "ascending"), ("x", "ascending"), ("y", "ascending"), ("line", "ascending")])
    lines, sides = t.column("line").to_numpy(), t.column("side").to_numpy()
    groups = np.stack([t.column(c).to_numpy() for c in ("band", "x", "y")])
    cuts = np.concatenate(([0], np.flatnonzero((groups[:, 1:] != groups[:, :-1]).any(0)) + 1, [len(lines)]))
    norms = [x.encode() for x in t.column("norm").to_pylist()]
    total = np.concatenate(([0], np.cumsum([len(x) for x in norms])))[cuts]
    found, lo = [], 0
    while lo < len(cuts) - 1:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PART, "right")) - 1)
        part = slice(cuts[lo], cuts[hi])
        ids, at, member = np.unique(lines[part], return_index=True, return_inverse=True)
        lead, near, pairs = _compared(kind, [norms[cuts[lo] + k] for k in at.tolist()], member, cuts[lo : hi + 1] - cuts[lo], sides[part].tolist(), star)
        some = np.flatnonzero(lead != member)
        if star:
            found.append((groups[0][part][some], ids[member[some]], ids[lead[some]], ~near[some]))
        else:
            some = some[near[some]]
            a, b = np.array(pairs, np.int64).reshape(-1, 2).T
            found.append((ids[np.concatenate((lead[some], member[a]))], ids[np.concatenate((member[some], member[b]))]))
        lo = hi
    textbuf.give_back()
    columns = [np.concatenate(x) for x in zip(*found, strict=True)]
    if star:
        return pa.table({"band": pa.array(columns[0]), "a": pa.array(columns[1]), "b": pa.array(columns[2], mask=columns[3])})
    return pa.table({"a": pa.array(columns[0]), "b": pa.array(columns[1])})


def _among(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Whether each of ``asked`` is among ``known``, which is sorted: by a table, and by search where two of them share a slot."""
    bits = len(known).bit_length() + 2
    odd, shift, none = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits), np.uint64((1 << 64) - 1)
    table = np.full(1 << bits, none)
    table[(known * odd >> shift).view(np.int64)] = known
    met = table[(asked * odd >> shift).view(np.int64)]
    there = met == asked
    open_ = np.flatnonzero(~there & (met != none))
    there[open_] = known[np.minimum(np.searchsorted(known, asked[open_]), len(known) - 1)] == asked[open_]
    return there


def _compared(kind: type[Lines], norms: list[bytes], member: np.ndarray, cuts: np.ndarray, sides: list[int], star: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Of the rows of groups, whose lines are ``norms[member]``: the first line of each one's group, whether it is near that, and without ``star`` pairs of rows that connect the rest."""
    bits, low, n = np.uint64(40), np.uint64((1 << 40) - 1), len(norms)
    lead = np.repeat(member[cuts[:-1]], np.diff(cuts))
    # Lines that are first in a group stand before the others.
    leads = np.bincount(lead, minlength=n) > 0
    order = np.argsort(~leads, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    h, at = kind.again([norms[k] for k in order.tolist()]).shingles()
    # Distinct shingles of every line as one sorted array: the line's place, then the shingle's code.
    keys = np.repeat(np.arange(n, dtype=np.uint64) << bits, np.diff(at)) | h
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    begin = np.append(np.searchsorted(keys, np.arange(n, dtype=np.uint64) << bits), len(keys))
    size = np.diff(begin)
    near = lead == member
    rows = np.flatnonzero(~near)
    if len(rows):
        # Every line against the first of its group, each pair once and all of them at once.
        pair, back = np.unique(place[lead[rows]] * n + place[member[rows]], return_inverse=True)
        head, other = np.divmod(pair, n)
        ends = np.cumsum(size[other])
        asked = keys[np.repeat(begin[other] - ends + size[other], size[other]) + np.arange(ends[-1])] & low
        asked |= np.repeat(head.astype(np.uint64) << bits, size[other])
        shared = np.add.reduceat(_among(keys[: begin[leads.sum()]], asked), ends - size[other], dtype=np.int64)
        near[rows] = (shared >= THRESHOLD * (size[head] + size[other] - shared))[back]
    pairs = []
    for lo, hi in [] if star else zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        # Groups with a line unlike the first: all their pairs.
        if hi - lo > 2 and not near[lo:hi].all():
            shingles = [keys[begin[k] : begin[k + 1]] & low for k in place[member[lo:hi]].tolist()]
            row = np.repeat(np.arange(hi - lo), size[place[member[lo:hi]]])
            marked = np.zeros((hi - lo, MARKS), bool)
            marked[row, (textbuf.mix(np.concatenate(shingles)) % np.uint64(MARKS)).astype(np.int64)] = True
            marks = [int.from_bytes(m.tobytes(), "little") for m in np.packbits(marked, 1)]
            pairs += [(lo + j, lo + i) for j, i in _similar(shingles, marks, sides[lo:hi], near[lo:hi].tolist())]
    return lead, near, pairs


def _similar(shingles: list[np.ndarray], marks: list[int], sides: list[int], near: list[bool]) -> list[tuple[int, int]]:
    """Similar pairs that, with the first line's links to those ``near`` it, connect all that is similar.

    With two sides only pairs across them are compared.
    Each mark of a line that another lacks stands for at least one shingle that the
    other lacks too, which bounds what they share; sets are made where that leaves the
    answer open.
    """
    root = [0 if x else i for i, x in enumerate(near)]
    size = [len(x) for x in shingles]
    sets: list[frozenset | None] = [None] * len(marks)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def known(x: int) -> frozenset:
        if sets[x] is None:
            sets[x] = frozenset(shingles[x].tolist())
        return sets[x]

    out = []
    one = len(set(sides)) == 1
    for i, n in enumerate(size):
        top, own = find(i), marks[i]
        for j in range(1, i):
            if (one or sides[i] != sides[j]) and root[j] != top and find(j) != top:
                both = n + size[j]
                most = min(n - (own & ~marks[j]).bit_count(), size[j] - (marks[j] & ~own).bit_count())
                if most >= THRESHOLD * (both - most):
                    shared = len(known(i) & known(j))
                    if shared >= THRESHOLD * (both - shared):
                        out.append((j, i))
                        root[find(i)] = find(j)
                        top = find(i)
    return out


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _dealt(batches: Iterator[pa.RecordBatch], n_bands: int, buckets: int, crowd: int) -> Iterator[pa.RecordBatch]:
    """The bands of lines, dealt by their highest bits: of each batch one row a bucket, and one without lines for bands in which more than ``crowd`` of its lines stand."""
    for batch in batches:
        lines, at = np.unique(batch.column(0).to_numpy(), return_index=True)
        bands = _longs(batch.column(1)).reshape(-1, n_bands)[at].view(np.uint64).ravel()
        order = np.argsort(bands)
        bands, lines = bands[order], lines[order // n_bands]
        first = np.flatnonzero(np.append(True, bands[1:] != bands[:-1])[: len(bands)])
        times = np.diff(np.append(first, len(bands)))
        full = times > crowd
        own = np.repeat(~full, times)
        for some, their in ((bands[own], lines[own]), (bands[first[full]], None)):
            bucket = ((some >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            cuts = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)[: len(bucket)]) + 1
            ends = np.append(0, cuts)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts - 1]), blobs(some, ends), pa.nulls(len(cuts), pa.binary()) if their is None else blobs(their, ends)], ["bucket", "bands", "lines"])


def _met_in_bucket(t: pa.Table) -> pa.Table:
    """``band, line`` of the bands of a bucket in which different lines stand; of those too full for a batch one row without a line."""
    none = pc.is_null(t.column("lines"))
    crowded, t = np.unique(_longs(t.filter(none).column("bands"))), t.filter(pc.invert(none))
    bands, lines = _longs(t.column("bands")), _longs(t.column("lines"))
    order = np.argsort(bands)
    bands, lines = bands[order], lines[order]
    first = np.flatnonzero(np.append(True, bands[1:] != bands[:-1])[: len(bands)])
    if len(first):
        met = (np.minimum.reduceat(lines, first) < np.maximum.reduceat(lines, first)) & ~np.isin(bands[first], crowded)
        own = np.repeat(met, np.diff(np.append(first, len(bands))))
        bands, lines = bands[own], lines[own]
        order = np.lexsort((lines, bands))
        bands, lines = bands[order], lines[order]
        own = np.append(True, (bands[1:] != bands[:-1]) | (lines[1:] != lines[:-1]))[: len(bands)]
        bands, lines = bands[own], lines[own]
    textbuf.give_back()
    return pa.table({"band": pa.array(np.append(bands, crowded)), "line": pa.concat_arrays([pa.array(lines, pa.int64()), pa.nulls(len(crowded), pa.int64())])})


def _standing_in(crowded: DataFrame, signed: DataFrame, kind: type[Lines]) -> DataFrame:
    """``band, line`` of all lines in the bands of ``crowded``."""
    bits = signed.sparkSession.sparkContext.broadcast(_bitmap(crowded.select(F.col("band").alias("k"))))

    def meeting(batches):
        for batch in batches:
            lines = batch.column(0).to_numpy()
            bands = _longs(batch.column(1))
            at = np.flatnonzero(_in_bitmap(bits.value, bands))
            yield pa.RecordBatch.from_arrays([pa.array(bands[at]), pa.array(lines[at // kind.n_bands])], ["band", "line"])

    maybe = signed.select("line", "bands").mapInArrow(meeting, "band long, line long").distinct()
    return maybe.join(crowded, "band", "left_semi")


def similar_links(signed: DataFrame, docs: DataFrame, kind: type[Lines] = Lines) -> DataFrame:
    """Links between keys of similar lines, or of what else ``kind`` takes from the texts of ``docs``."""
    buckets = 1 + signed.count() * kind.n_bands // PAIRS
    dealt = signed.select("line", "bands").mapInArrow(lambda batches, crowd=CROWD: _dealt(batches, kind.n_bands, buckets, crowd), "bucket int, bands binary, lines binary")
    met, _ = written(dealt.groupBy("bucket").applyInArrow(_met_in_bucket, "band long, line long"), "met")
    members, crowded = met.where("line is not null"), met.where("line is null").select("band")
    if not crowded.isEmpty():
        members = members.unionByName(written(_standing_in(crowded, signed, kind), "members")[0])
    # Groups with the same lines in several bands are compared once.
    groups = members.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.xxhash64("line").cast("decimal(38,0)")).alias("sum"), F.min("line").alias("lead"))
    groups = groups.groupBy("n", "sum").agg(F.min("band").alias("band"), F.min("lead").alias("lead")).select("band", "lead", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    wanted, _ = written(members.join(groups, "band"), "groups")
    needed = wanted.select("line").distinct()
    text_bits = signed.sparkSession.sparkContext.broadcast(_bitmap(needed.select(F.col("line").alias("k"))))

    def texts(batches):
        for batch in batches:
            column = lowered(batch.column(0))
            for i, j in textbuf.blocks(column):
                lines = kind(column[i:j])
                keys = lines.keys()
                at = np.flatnonzero(_in_bitmap(text_bits.value, keys))
                at = at[np.sort(np.unique(keys[at], return_index=True)[1])]
                yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array([lines.norms[k].decode("utf-8", "replace") for k in at.tolist()], pa.string())], ["line", "norm"])
            textbuf.give_back()

    found = docs.select("text").mapInArrow(texts, "line long, norm string")
    known = found.join(needed, "line", "left_semi").groupBy("line").agg(F.min("norm").alias("norm"))
    large = wanted.where("tiles > 1")
    once = large.isEmpty()
    if not once:
        known, _ = written(known, "norms", "zstd")
    part = F.pmod(F.xxhash64("line", F.lit(3)), F.col("tiles")).cast("int")
    nothing = F.lit(0)

    def compared(rows: DataFrame, schema: str, star: bool) -> DataFrame:
        bins = 1 + rows.count() // kind.bin
        rows = rows if "lead" in rows.columns else rows.withColumn("lead", F.xxhash64("band", "x", "y"))
        dealt = rows.join(known.hint("shuffle_hash"), "line").withColumn("bin", F.pmod(F.xxhash64("lead"), F.lit(bins)))
        return dealt.groupBy("bin").applyInArrow(lambda t: _verified(t, kind, star), schema)

    # Groups of one first line lie together: each holds it, and often other lines of the next.
    small = wanted.where("tiles = 1").select("lead", "band", nothing.alias("x"), nothing.alias("y"), nothing.alias("side"), "line")
    links = compared(small, "a long, b long", False)
    if once:
        return links
    # Each part of a large group has the group's first line.
    first = large.groupBy("band", "tiles").agg(F.min("line").alias("line"))
    parts = large.select("band", part.alias("x"), "line").unionByName(first.select("band", F.explode(F.sequence(nothing, F.col("tiles") - 1)).alias("x"), "line")).distinct()
    near, _ = written(compared(parts.select("band", "x", nothing.alias("y"), nothing.alias("side"), "line"), "band long, a long, b long", True), "stars")
    rest = near.where("b is null").select("band", F.col("a").alias("line")).distinct()
    counts = rest.groupBy("band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("homes"))
    home = F.pmod(F.xxhash64("line", F.lit(5)), F.col("homes")).cast("int")
    both = large.join(counts.hint("shuffle_hash"), "band")
    visits = both.select("band", F.explode(F.sequence(nothing, F.col("homes") - 1)).alias("x"), part.alias("y"), F.lit(1).alias("side"), "line")
    hosts = both.join(rest.hint("shuffle_hash"), ["band", "line"]).select("band", home.alias("x"), F.explode(F.sequence(nothing, F.col("tiles") - 1)).alias("y"), F.lit(0).alias("side"), "line")
    unlike, _ = written(visits.unionByName(hosts), "unlike")
    return links.unionByName(near.where("b is not null").select("a", "b")).unionByName(compared(unlike, "a long, b long", False))


def _met(many: DataFrame, ones: DataFrame, key: str, hot: Column) -> DataFrame:
    """``many`` joined with ``ones``, which has one row for each key; the rows of ``ones`` that are ``hot``, fewer than FEW, are broadcast."""
    few = ones.where(hot)
    rest = many.join(F.broadcast(few.select(key)), key, "left_anti")
    return many.join(F.broadcast(few), key).unionByName(rest.join(ones.where(~hot).hint("shuffle_hash"), key))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``row, position`` of every line to drop: all but its component's first occurrence.

    ``row`` is the hash of doc_id and text, so repeated rows count as one
    document and give the same rows here.  The first occurrence is that of the smallest doc_id (null last),
    then row, then position.
    """
    keyed = docs.select(_row_key().alias("row"), "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed, _ = written(keyed.mapInArrow(_signed, f"row long, doc_id {kind}, position long, line long, bands binary"), "lines", "zstd")
    spark, before = docs.sparkSession, made()
    links = similar_links(signed, docs)
    scratch = [x for x in made() if x not in before]
    roots = components(links).select(F.col("node").alias("line"), "root")
    for x in scratch:
        remove(spark, x)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "position")
    lines = signed.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    # A line that stands once and has no like stays, and is not looked at any more.
    lines, _ = written(lines.join(roots.hint("shuffle_hash"), "line", "left").where("n > 1 or root is not null").select("line", F.coalesce("root", "line").alias("root"), "first", "n"), "firsts", "zstd")
    groups, _ = written(lines.groupBy("root").agg(F.min("first").alias("top"), F.sum("n").alias("all"), F.count("*").alias("lines")).where("all > 1"), "roots")
    n_all, n_lines = lines.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tops = _met(lines.select("line", "root", "n"), groups.select("root", "top", "lines"), "root", F.col("lines") > n_lines / FEW + 1).select("line", "top", "n")
    tops, _ = written(tops, "tops", "zstd")
    found = _met(signed.select("line", place.alias("place")), tops, "line", F.col("n") > n_all / FEW + 1)
    return found.where("place <> top").select("place.row", "place.position")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and ``n_lines``, ``n_dropped`` (long) after its columns.

    Blank lines are never dropped.  Null texts stay null with no lines; empty
    texts stay empty; a text all of whose lines go becomes its blank lines or
    empty.  Repeated rows stay and lose the same lines.  Rows with a null doc_id
    take part.  Columns n_lines and n_dropped of ``docs`` are replaced.
    """
    row, gone = unused(docs, "_row"), unused(docs, "_drop")
    drop = repeated_lines(docs).groupBy(F.col("row").alias(row)).agg(F.collect_set("position").alias(gone))
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.array_contains(gone, i.cast("long")))
    joined = docs.withColumn(row, _row_key()).join(drop.hint("shuffle_hash"), row, "left")
    return joined.select(
        *(F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
    )


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """The query: every document with its text after line dedup, and the counts of its lines."""
    return deduplicated(input_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")
