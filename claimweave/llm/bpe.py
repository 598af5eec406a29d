"""Byte-level BPE encoding and decoding by tree concatenation.

``Vocabulary`` reads a public tokenizer's file and reproduces its ids exactly.
A text is cut into leaves at any character, all leaves of a batch are encoded at
once, and each join is then repaired: a window around it is encoded again and
grown until its first and last pieces equal what both sides already have.  The
windows' edges are places where the split pattern always splits (after a
character that is not white space, before one that is), so agreement there
proves the whole.  Pieces that the pattern leaves long are halved in the same
way down to leaves of ``SHORT`` bytes; at their joins two token lists agree when
each pair of neighbouring tokens encodes to itself, which for merge-ordered BPE
makes the whole list the encoding.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from . import textbuf
from .store import input_table

#: Characters of a leaf of a text; bytes of a leaf of an unsplit piece.
LEAF, SHORT = 16384, 24
#: Bytes beyond which a window around a join is merged by itself.
WIDE = 96
#: Characters of text encoded at once.
BLOCK = 2 << 20
#: Pieces of up to SHORT bytes whose ids a vocabulary remembers from block to block, and the bits of their table's places.
KNOWN, PLACES = 1 << 19, 20
_NONE = np.int32(2**31 - 1)
OTHER, LETTER, NUMBER, SPACE, UNKNOWN, EDGE = range(6)
#: The code points of Unicode's White_Space, and the split pattern's endings after an apostrophe.
WHITE = [0x20, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x09, 0x0E), *range(0x2000, 0x200B)]
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def _classes() -> np.ndarray:
    """The split pattern's class of each code point, as far as this Python's Unicode tables know."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))
        out[cp] = LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else UNKNOWN if kind == "Cn" else OTHER
    out[WHITE] = SPACE
    return out


class _PairTable:
    """From a pair of ids to its merge's rank and result, by two-way hashing in numpy."""

    def __init__(self, pairs: list[tuple[int, int]], results: list[int]) -> None:
        self.bits = max(10, len(pairs).bit_length() + 1)
        size = 2 << self.bits
        keys, at = [-1] * size, [0] * size
        packed = np.array(pairs, np.uint64).reshape(-1, 2)
        packed = packed[:, 0] << np.uint64(32) | packed[:, 1]
        homes = np.stack(self._homes(packed)).T.tolist()
        for i, key in enumerate(packed.tolist()):
            item, where = (key, i), homes[i]
            spot = where[0] if keys[where[0]] < 0 else where[1]
            for _ in range(500):
                old = (keys[spot], at[spot])
                keys[spot], at[spot] = item
                if old[0] < 0:
                    break
                item = old
                there = homes[old[1]]
                spot = there[1] if spot == there[0] else there[0]
            else:
                raise ValueError("the merges do not fit the table")
        self.keys = np.array([k if k >= 0 else (1 << 64) - 1 for k in keys], np.uint64)
        self.rank = np.array(at, np.int32)
        self.result = np.array(results, np.int32)

    def _homes(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = key * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        down = np.uint64(64 - self.bits)
        return (h >> down).astype(np.int64), ((h << np.uint64(self.bits)) >> down).astype(np.int64) + (1 << self.bits)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; ``_NONE`` where no merge has it."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        one, two = self._homes(key)
        return np.where(self.keys[one] == key, self.rank[one], np.where(self.keys[two] == key, self.rank[two], _NONE))


class Vocabulary:
    """A byte-level BPE vocabulary from a ``tokenizer.json`` file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        step, model = d["pre_tokenizer"], d["model"]
        if d["normalizer"] or step["type"] != "ByteLevel" or step["add_prefix_space"] or not step["use_regex"] or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError(f"{path} is not plain byte-level BPE")
        added = {t["content"]: t["id"] for t in d["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in d["added_tokens"]):
            raise ValueError("added tokens that strip their neighbours are not supported")
        self.path = path
        shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ids = model["vocab"] | added
        words = [b""] * (max(ids.values()) + 1)
        for text, i in ids.items():
            words[i] = text.encode() if text in added else bytes(byte_of[c] for c in text)
        self.special = [(text.encode(), i) for text, i in sorted(added.items(), key=lambda x: -len(x[0]))]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.blob = np.frombuffer(b"".join(words), np.uint8)
        self.at = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.of_byte = np.zeros(256, np.int32)
        for c, b in byte_of.items():
            self.of_byte[b] = ids[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = _PairTable([(ids[a], ids[b]) for a, b in pairs], [ids[a + b] for a, b in pairs])
        self.classes = _classes().copy()
        low = int(self.of_byte.max()) + 1
        pair = np.arange(low)
        #: The ranks of pairs of two bytes' ids, which most pieces begin with.
        self.byte_pairs = self.pairs.ranks(np.repeat(pair, low).astype(np.int32), np.tile(pair, low).astype(np.int32)) if low <= 1024 else None
        self.low = low
        # Remembered pieces: hashes at one of two places, there the place of their ids in the pool and the number of ids.
        self.hashes, self.spans = np.zeros(1 << PLACES, np.uint64), np.zeros(1 << PLACES, np.int64)
        self.n_known, self.pool, self.used = 0, np.zeros(1 << 16, np.int32), 0
        #: Whether pairs of neighbouring ids encode to themselves, as far as asked.
        self.agrees: dict[tuple[int, int], bool] = {}
        self.merges: dict[int, tuple[int, int]] | None = None

    # -- encoding -----------------------------------------------------------------

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (n + 1 entries)."""
        plain, marks = [], []  # marks: for each text, its plain parts' numbers and special ids in order
        for t in texts:
            parts: list[str | int] = [t]
            for word, i in self.special:
                w = word.decode()
                if w in t:
                    parts = [y for x in parts for y in (_between(x.split(w), i) if isinstance(x, str) else [x])]
            marks.append([p if isinstance(p, int) else -1 - _add(plain, p) for p in parts if p != ""])
        ids, first = self._texts(plain)
        if all(len(m) <= 1 and (not m or m[0] < 0) for m in marks):
            counts = np.array([first[-m[0]] - first[-1 - m[0]] if m else 0 for m in marks], np.int64)
            return ids, np.concatenate(([0], np.cumsum(counts)))
        out = [np.concatenate([np.zeros(0, np.int32), *(np.array([p], np.int32) if p >= 0 else ids[first[-1 - p] : first[-p]] for p in m)]) for m in marks]
        return np.concatenate([np.zeros(0, np.int32), *out]), np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int64)

    def _texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, for texts without special tokens: leaves at once, then each join."""
        leaves, joins = [], []  # a join: (text, its left leaf)
        first = [0]
        for t in texts:
            n = max(1, -(-len(t) // LEAF))
            cuts = [len(t) * i // n for i in range(n + 1)]
            joins += range(len(leaves), len(leaves) + n - 1)
            leaves += [t[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            first.append(len(leaves))
        ids, at = self._leaves(leaves)
        swaps = self._joins(leaves, joins, ids, at) if joins else []
        if swaps:
            parts, done = [], 0
            shift = np.zeros(len(ids) + 1, np.int64)
            for a, b, new in swaps:
                parts += [ids[done:a], new]
                shift[b] += len(new) - (b - a)
                done = b
            ids, shift = np.concatenate([*parts, ids[done:]]), np.cumsum(shift)
            return ids, at[first] + shift[at[first]]
        return ids, at[first]

    def _joins(self, leaves: list[str], joins: list[int], ids: np.ndarray, at: np.ndarray) -> list:
        """What to replace at the joins of a text's leaves: (from, to, new ids), in order.

        The window of a join starts with 16 characters on each side and doubles.
        """
        found, open_ = {}, {j: 16 for j in joins}
        while open_:
            tried = {}
            for j, reach in open_.items():
                left, right = leaves[j], leaves[j + 1]
                a, b = self._edge(left, len(left) - reach, -1), self._edge(right, reach, 1)
                tried[j] = (left[a:] + right[:b], a, b)
            got, first = self._leaves([w for w, _, _ in tried.values()])
            again = {}
            for n, (j, (window, a, b)) in enumerate(tried.items()):
                new = got[first[n] : first[n + 1]]
                lo = self._tokens_from(ids[at[j] : at[j + 1]], len(leaves[j][a:].encode()))
                hi = self._tokens_to(ids[at[j + 1] : at[j + 2]], len(leaves[j + 1][:b].encode()))
                l_ids, r_ids = ids[at[j] + lo : at[j + 1]], ids[at[j + 1] : at[j + 1] + hi]
                whole = open_[j] >= max(len(leaves[j]), len(leaves[j + 1]))
                # Each side agrees if the window's first (last) id is the one that the side has there.
                if (len(new) and len(l_ids) and len(r_ids) and new[0] == l_ids[0] and new[-1] == r_ids[-1] and a > 0 and b < len(leaves[j + 1])):
                    found[j] = (at[j] + lo, at[j + 1] + hi, new)
                elif whole:
                    found[j] = None
                else:
                    again[j] = open_[j] * 2
            open_ = again
        out, k = [], 0
        joins = sorted(found)
        while k < len(joins):
            j = joins[k]
            if found[j] is None or (k + 1 < len(joins) and joins[k + 1] == j + 1 and (found[j + 1] is None or found[j + 1][0] < found[j][1])):
                # No place to cut between these leaves: all that hang together are one unsplit text.
                lo = j
                while out and out[-1][1] > at[lo]:
                    _, _, _ = out.pop()
                    lo -= 1
                hi = j + 1
                while k + 1 < len(joins) and joins[k + 1] == hi:
                    k, hi = k + 1, hi + 1
                while lo - 1 in found:
                    lo -= 1
                    while out and out[-1][1] > at[lo]:
                        out.pop()
                out.append((at[lo], at[hi + 1], self._leaves(["".join(leaves[lo : hi + 1])])[0]))
            else:
                out.append(found[j])
            k += 1
        return out

    @staticmethod
    def _edge(text: str, near: int, step: int) -> int:
        """The nearest place at or beyond ``near`` where every reading of the text splits, else its end."""
        i = min(max(near, 0), len(text))
        while 0 < i < len(text):
            if text[i] == " " and not text[i - 1].isspace():
                return i
            i += step
        return i

    def _tokens_from(self, ids: np.ndarray, size: int) -> int:
        """Where the last ``size`` bytes begin; past the end if inside an id."""
        back = np.cumsum(self.sizes[ids[::-1]])
        k = int(np.searchsorted(back, size))
        return len(ids) - k - 1 if size and k < len(back) and back[k] == size else len(ids)

    def _tokens_to(self, ids: np.ndarray, size: int) -> int:
        ahead = np.cumsum(self.sizes[ids])
        k = int(np.searchsorted(ahead, size))
        return k + 1 if size and k < len(ahead) and ahead[k] == size else 0

    def _leaves(self, leaves: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode each string by itself, all at once."""
        if not leaves:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        text = "\x00".join(leaves) + "\x00"
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        base = np.concatenate(([0], np.cumsum(np.fromiter((len(t) + 1 for t in leaves), np.int64, len(leaves)))))
        kind = self.classes[cps]
        if (kind == UNKNOWN).any():
            self._learn(np.unique(cps[kind == UNKNOWN]))
            kind = self.classes[cps]
        kind[base[1:] - 1] = EDGE
        edge = self._starts(cps, kind, base)
        # Words as slices of bytes.
        data = np.frombuffer(text.encode(), np.uint8)
        place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        edge[base[1:] - 1] = True
        cut = np.flatnonzero(edge)
        real = kind[cut] != EDGE
        begin, end = place[cut[real]], place[cut[1:][real[:-1]]] if len(cut) > 1 else place[:0]
        many, at, pool = self._found(textbuf.slices(textbuf.prefix(data), begin, end) | np.uint64(1), data, begin, end)
        total = np.concatenate(([0], np.cumsum(many)))
        ids = pool[np.repeat(at - total[:-1], many) + np.arange(total[-1])]
        return ids, total[np.searchsorted(begin, place[base])]

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << PLACES) - 1)
        return (h >> np.uint64(40) & mask).astype(np.int64), (h >> np.uint64(12) & mask).astype(np.int64)

    def _found(self, h: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of ids of pieces by their hashes, where they begin, and the pool they are in; new pieces are remembered while there is room."""
        one, two = self._places(h)
        second = self.hashes[two] == h
        span = self.spans[np.where(second, two, one)]
        new = np.flatnonzero(~second & (self.hashes[one] != h))
        if len(new):
            key, first, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            a, b = begin[new[first]], end[new[first]]
            order = np.argsort(b - a > SHORT, kind="stable")  # long ones last: they are not remembered
            ids, at = self._pieces(data, a[order], b[order])
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate((self.pool[: self.used], np.empty(self.used + 2 * len(ids), np.int32)))
            self.pool[self.used : self.used + len(ids)] = ids
            got = np.empty(len(key), np.int64)
            got[order] = self.used + at[:-1] << 24 | np.diff(at)
            span[new] = got[inverse]
            if self.n_known < KNOWN:
                short = order[: int((b - a <= SHORT).sum())]
                for choice in range(2):
                    places = self._places(key[short])[choice]
                    free = self.hashes[places] == 0
                    self.hashes[places[free]], self.spans[places[free]] = key[short][free], got[short][free]
                    short = short[self.hashes[places] != key[short]]  # another has the place
                n = int((b - a <= SHORT).sum())
                self.n_known += n
                self.used += int(at[n])
        return span & 0xFFFFFF, span >> 24, self.pool

    def _learn(self, unknown: np.ndarray) -> None:
        """Ask the library for the class of characters newer than this Python's tables."""
        from tokenizers import Tokenizer

        split = Tokenizer.from_file(self.path).pre_tokenizer.pre_tokenize_str
        for cp in unknown.tolist():
            self.classes[cp] = next((k for k, by in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(by + chr(cp))) == 1), SPACE)

    @staticmethod
    def _starts(cps: np.ndarray, kind: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Whether a piece of the split pattern begins at each character."""
        n = len(cps)
        fresh = np.empty(n, bool)
        fresh[0] = True
        np.not_equal(kind[1:], kind[:-1], out=fresh[1:])
        fresh[base[1:] - 1] = True
        fresh[base[:-1]] = True
        run = np.flatnonzero(fresh)
        stop = np.append(run[1:], n)
        k = kind[run]
        before = np.where(run > 0, kind[run - 1], EDGE)
        lead = (before == SPACE) & (cps[run - 1] == 0x20)  # the space before joins the piece
        text = (k != SPACE) & (k != EDGE)
        # An apostrophe alone, then one of the endings.
        tick = np.flatnonzero((k == OTHER) & (stop - run == 1) & (cps[run] == 0x27) & ~lead)
        tick = tick[(tick + 1 < len(run)) & (k[np.minimum(tick + 1, len(run) - 1)] == LETTER)]
        skip, extra = np.zeros(len(run), bool), []
        for t in tick.tolist():
            a, b = run[t + 1], stop[t + 1]
            word = "".join(map(chr, cps[a : min(a + 2, b)].tolist()))
            size = next((len(e) for e in ENDINGS if word.startswith(e)), 0)
            if size:
                skip[t + 1] = True
                if a + size < b:
                    extra.append(a + size)
        out = [run[text & ~skip] - lead[text & ~skip], np.array(extra, np.int64)]
        # White space: all but its last character, which a space gives to the next piece.
        a, b = run[k == SPACE], stop[k == SPACE]
        last = kind[np.minimum(b, n - 1)] == EDGE
        out.append(a[last | (b - a > 1)])
        alone = ~last & (cps[b - 1] != 0x20)
        out.append(b[alone] - 1)
        first = np.zeros(n, bool)
        first[np.concatenate(out)] = True
        return first

    # -- pieces -------------------------------------------------------------------

    def _pieces(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each byte slice as one piece, in a row, and where they begin."""
        size = end - begin
        count = np.zeros(len(begin), np.int64)
        groups = []
        order = np.argsort(size, kind="stable")
        sorted_ = size[order]
        for n in range(1, SHORT + 1):
            rows = order[np.searchsorted(sorted_, n) : np.searchsorted(sorted_, n, "right")]
            for i in range(0, len(rows), 1 << 15):
                some = rows[i : i + (1 << 15)]
                ids, used = self._merge(self.of_byte[data[begin[some][:, None] + np.arange(n)]])
                count[some] = used
                groups.append((some, ids))
        long_ = {int(i): self._long(data[begin[i] : end[i]].tobytes()) for i in order[np.searchsorted(sorted_, SHORT, "right") :]}
        for i, ids in long_.items():
            count[i] = len(ids)
        at = np.concatenate(([0], np.cumsum(count)))
        pool = np.empty(at[-1], np.int32)
        for some, ids in groups:
            live = np.arange(ids.shape[1]) < count[some][:, None]
            pool[(at[some][:, None] + np.arange(ids.shape[1]))[live]] = ids[live]
        for i, ids in long_.items():
            pool[at[i] : at[i + 1]] = ids
        return pool, at

    def _merge(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every row of ids to its end, all rows in step; the rows, and how many ids each has left."""
        n, width = ids.shape
        used = np.full(n, width, np.int64)
        if width == 1 or not n:
            return ids, used
        if self.byte_pairs is not None:
            rank = self.byte_pairs.take(ids[:, :-1] * self.low + ids[:, 1:])  # every row begins as bytes
        else:
            rank = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        rows, out, left = np.arange(n), ids.copy(), width
        work = ids
        while len(rows):
            j = rank.argmin(1)
            best = rank[np.arange(len(rows)), j]
            go = best != _NONE
            if not go.all():
                done = rows[~go]
                out[done, :left] = work[~go]
                used[done] = left
                rows, work, rank, j, best = rows[go], work[go], rank[go], j[go], best[go]
                if not len(rows):
                    break
            r = np.arange(len(rows))
            past = np.arange(left - 1) > j[:, None]
            work = np.where(past, work[:, 1:], work[:, :-1])
            work[r, j] = self.pairs.result[best]
            left -= 1
            if left == 1:
                out[rows, 0] = work[:, 0]
                used[rows] = 1
                break
            rank = np.where(past[:, :-1], rank[:, 1:], rank[:, :-1])
            prev = np.flatnonzero(j > 0)
            rank[prev, j[prev] - 1] = self.pairs.ranks(work[prev, j[prev] - 1], work[prev, j[prev]])
            nxt = np.flatnonzero(j < left - 1)
            rank[nxt, j[nxt]] = self.pairs.ranks(work[nxt, j[nxt]], work[nxt, j[nxt] + 1])
        return out, used

    def _long(self, piece: bytes) -> np.ndarray:
        """A long unsplit piece: leaves together, then pairs of neighbours joined, level by level."""
        n = 1 << (-(-len(piece) // SHORT) - 1).bit_length()
        cuts = [len(piece) * i // n for i in range(n + 1)]
        parts: list = [None] * n
        sizes = np.diff(cuts)
        data = self.of_byte[np.frombuffer(piece, np.uint8)]
        for size in np.unique(sizes).tolist():
            which = np.flatnonzero(sizes == size)
            ids, used = self._merge(data[np.array(cuts)[which][:, None] + np.arange(size)])
            for w, row, k in zip(which.tolist(), ids, used.tolist(), strict=True):
                parts[w] = row[:k]
        while len(parts) > 1:
            parts = self._joined(parts[::2], parts[1::2])
        return parts[0]

    def _merged(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Each row of byte ids merged to its end, rows of equal length together, long ones by themselves."""
        sizes = np.array([len(r) for r in rows], np.int64)
        out: list = [None if len(r) <= WIDE else self._by_heap(r) for r in rows]
        for n in np.unique(sizes[sizes <= WIDE]).tolist():
            which = np.flatnonzero(sizes == n)
            many = max(1, (1 << 19) // n)
            for i in range(0, len(which), many):
                some = which[i : i + many].tolist()
                ids, used = self._merge(np.stack([rows[k] for k in some]))
                for k, row, m in zip(some, ids, used.tolist(), strict=True):
                    out[k] = row[:m]
        return out

    def _by_heap(self, ids: np.ndarray) -> np.ndarray:
        """One row of byte ids merged to its end: neighbours by rank, then place, from a heap."""
        if self.merges is None:
            t = self.pairs
            self.merges = dict(zip(t.keys.tolist(), zip(t.rank.tolist(), t.result[t.rank].tolist(), strict=True), strict=True))
        merges, now = self.merges, ids.tolist()
        n = len(now)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(m[0], i, m[1]) for i in range(n - 1) if (m := merges.get(now[i] << 32 | now[i + 1]))]
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i]
            if j < 0 or now[i] < 0 or (m := merges.get(now[i] << 32 | now[j])) is None or m[0] != rank:
                continue  # its ids have been merged otherwise
            now[i], now[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b >= 0 and (m := merges.get(now[a] << 32 | now[b])):
                    heapq.heappush(heap, (m[0], a, m[1]))
        return np.array([x for x in now if x >= 0], np.int32)

    def _agreeing(self, pairs: list[tuple[int, int]]) -> list[bool]:
        """Whether each pair of neighbouring ids encodes to itself; a place without two ids (-1) does."""
        if len(self.agrees) > KNOWN:
            self.agrees.clear()
        new = [p for p in dict.fromkeys(pairs) if p not in self.agrees]
        got = self._merged([self.of_byte[self._bytes(np.array(p))] if min(p) >= 0 else self.of_byte[:1] for p in new])
        self.agrees |= {p: min(p) < 0 or ids.tolist() == list(p) for p, ids in zip(new, got, strict=True)}
        return [self.agrees[p] for p in pairs]

    def _joined(self, left: list[np.ndarray], right: list[np.ndarray]) -> list[np.ndarray]:
        """Encodings of neighbouring parts as the encoding of both together, all joins of a level at once.

        The window of a join holds two ids of each side and doubles until it agrees with both.
        """
        out: list = [None] * len(left)
        fit = self._agreeing([(int(x[-1]), int(y[0])) for x, y in zip(left, right, strict=True)])
        open_ = []
        for k, (x, y) in enumerate(zip(left, right, strict=True)):
            if fit[k]:
                out[k] = np.concatenate((x, y))
            else:
                open_.append(k)
        reach = 2
        while open_:
            cuts = [(max(0, len(left[k]) - reach), min(len(right[k]), reach)) for k in open_]
            new = self._merged([self.of_byte[self._bytes(np.concatenate((left[k][a:], right[k][:b])))] for k, (a, b) in zip(open_, cuts, strict=True)])
            before = self._agreeing([(int(left[k][a - 1]) if a else -1, int(x[0])) for k, (a, _), x in zip(open_, cuts, new, strict=True)])
            after = self._agreeing([(int(x[-1]), int(right[k][b]) if b < len(right[k]) else -1) for k, (_, b), x in zip(open_, cuts, new, strict=True)])
            again = []
            for k, (a, b), x, lo, hi in zip(open_, cuts, new, before, after, strict=True):
                if lo and hi:
                    out[k] = np.concatenate((left[k][:a], x, right[k][b:]))
                else:
                    again.append(k)
            open_, reach = again, reach * 2
        return out

    # -- decoding -----------------------------------------------------------------

    def _bytes(self, ids: np.ndarray) -> np.ndarray:
        size = self.sizes[ids]
        total = np.cumsum(size)
        return self.blob[np.repeat(self.at[ids] - (total - size), size) + np.arange(total[-1] if len(total) else 0)]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """The texts of rows of ids; bytes that are no character become U+FFFD, special tokens their text."""
        data = self._bytes(ids).tobytes()
        at = np.concatenate(([0], np.cumsum(self.sizes[ids])))[first].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


def _between(parts: list[str], i: int) -> list:
    return [x for p in parts for x in (p, i)][:-1]


def _add(to: list, x) -> int:
    to.append(x)
    return len(to) - 1


@functools.lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """One copy for each worker process."""
    return Vocabulary(path)


def text_blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of a text column with about ``most`` bytes each; null is empty."""
    texts = textbuf.texts_of(column)
    for i, j in textbuf.blocks(texts, most):
        yield i, j, [t.decode("utf-8", "replace") for t in texts[i:j]]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with a column ``ids`` (array of int) in place of ``text``; a column named ids is replaced.

    Null and empty texts have no ids.  Rows, also repeated ones, keep their
    other columns.  An empty table gives an empty result.
    """
    path = path or default_path()
    others = [c for c in docs.columns if c.lower() not in ("text", "ids")]
    schema = docs.select(*(docs[c] for c in others)).schema.add("ids", ArrayType(IntegerType()))

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for i, j, texts in text_blocks(batch.column(0)):
                ids, first = v.encode(texts)
                column = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c[i:j] for c in batch.columns[1:]), column], [*others, "ids"])

    return docs.select(docs["text"], *(docs[c] for c in others)).mapInArrow(run, schema)


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` with a column ``text`` in place of ``ids``; null ids give an empty text."""
    path = path or default_path()
    others = [c for c in rows.columns if c.lower() not in ("text", "ids")]
    schema = rows.select(*(rows[c] for c in others)).schema.add("text", "string")

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            lists = batch.column(0).fill_null([]).cast(pa.large_list(pa.int32()))
            first = np.asarray(lists.offsets)
            out = v.decode(np.asarray(lists.values)[first[0] : first[-1]], first - first[0])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.string())], [*others, "text"])

    return rows.select(rows["ids"], *(rows[c] for c in others)).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: both directions in one pass over whole texts; with ``keep_ids`` also ``ids``.

    Null and empty texts have no ids.  Repeated rows stay, a null doc_id too; an
    empty table gives an empty result; other columns are ignored.
    """
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for i, j, texts in text_blocks(batch.column(1)):
                ids, first = v.encode(texts)
                words, cuts = ids.astype("<u4"), first.tolist()
                sums = [hashlib.sha256(words[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)]
                back = [hashlib.sha256(t.encode()).hexdigest() for t in v.decode(ids, first)]
                columns = {"doc_id": batch.column(0)[i:j], "n_tokens": pa.array(np.diff(first)), "ids_sha256": pa.array(sums), "decoded_sha256": pa.array(back)}
                if keep_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    """The query: every document encoded and decoded."""
    return round_trip(input_table(spark, sf_dir, "documents"))
