"""An adaptive context-mixing range coder for token ids, many blocks in step.

Every block of ids starts from the same reset state and is coded by itself, so
blocks decode in any order.  All blocks given are coded side by side: one numpy
step codes the next id of each.  The model of a block:

- order 2 and order 1: a table from the hash of the last two ids (of the last
  one) to the id that followed last, with a count of how often it was right;
- order 0: counts of classes of ids of like size (four to a power of two), which
  become frequencies at fixed places of the block; within a class ids are alike;
- of order 2's and order 1's ids the one of the surer order is the guess (order
  2's, if they are equally sure); the chance that it is right is mixed in the
  logistic domain: two contexts (both orders' confidences, and the recent past)
  each have a learnt logit, and learnt integer weights add them up.

One id takes one coding step: an interval for "as guessed", and the rest for
order 0.  Everything is integer arithmetic, so any machine decodes what another
has coded.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids of a block, and blocks coded side by side at most.
SIZE, LANES = 1024, 8192
_FLAG, _CLASS, _INNER = 12, 12, 13  # bits of the choice among orders, of the classes' frequencies, and of the place in a class
_LOW = _CLASS + _INNER
_BITS = _FLAG + _LOW
_SLOTS = 1 << 8  # of each order's table; small tables stay in the processor's cache
_PAST, _SURE = 16, 32  # values of the two contexts
_TOP, _FLOOR, _WORD, _ONE = np.uint64(48), np.uint64(1 << 48), np.uint64(16), np.uint64(1)
#: Steps between new logits and between new weights, and the steps after which the classes get new frequencies.
_LEARNT, _WEIGHED = 8, 16
_COUNTED = frozenset([16, 48, 112, 240, *range(496, 1 << 20, 256)])
_SQUASH = np.array([min(4063, max(32, round(4096 / (1 + np.exp(-x / 256))))) for x in range(-2047, 2048)], np.int32)
#: The next confidence after a miss (0 to 7) and after a hit; 0: the slot is empty.
_NEXT = np.array([1 + (s >> 2) for s in range(8)] + [min(s + 1, 7) for s in range(8)], np.int32)
_HASH = np.array([[2654435761], [40503 << 12]], np.int64)


def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of every id; the first id of every class, and by how many bits a place in it falls short of _INNER."""
    k = [max(i.bit_length() - 3, 0) for i in range(1 << 16)]
    kind = np.array([(i >> b) + 4 * b for i, b in enumerate(k)], np.int64)
    first = np.flatnonzero(np.diff(kind, prepend=-1))
    return kind.astype(np.uint8), first, _INNER - np.array(k, np.int64)[first]


_KIND, _FIRST, _STEP = _kinds()
_N = len(_FIRST)


def _start() -> tuple[np.ndarray, np.ndarray]:
    """The logits at the start, 256 to 1: by the orders' confidences and whether they agree, and by the past."""
    sure = np.array([-8 if not two + one else max(two, one) / 2 - 1.5 + (0.75 if same else -0.25) for two in range(8) for one in (0, 3) for same in range(2)])
    past = np.array([0.5 * p.bit_count() - 1 for p in range(_PAST)])
    return np.clip(sure * 256, -2047, 2047).astype(np.int32), (past * 256).astype(np.int32)


class _Model:
    """The state of ``n`` blocks; ``step`` gives the guess's share, ``learn`` takes the ids coded.

    Arrays of two rows hold order 2, then order 1.
    """

    def __init__(self, n: int) -> None:
        self.n, self.t = n, 0
        self.rows = rows = np.arange(n, dtype=np.int64)
        self.base, self.base_sure, self.base_past = np.arange(2 * n, dtype=np.int64).reshape(2, n) * _SLOTS, rows * _SURE, rows * _PAST
        # Entries: the id that followed, times 8, and its confidence.
        self.table = np.full(2 * n * _SLOTS, -8, np.int32)
        self.last, self.before, self.past = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        sure, past = _start()
        self.sure, self.of_past = np.tile(sure, n), np.tile(past, n)
        self.w_sure, self.w_past = np.full(n, 65536, np.int32), np.full(n, 45000, np.int32)
        self.counts = np.ones((_N, n), np.int32)
        self.seen = np.empty((256, n), np.int32)
        self.ends = np.empty((_N, n), np.int16)
        self.refresh(0)

    def refresh(self, steps: int) -> None:
        """New frequencies, each class at least 1 of 2 ** _CLASS, from the classes of the last ``steps`` steps."""
        if steps:
            self.counts += 2 * np.bincount(self.seen[:steps].ravel(), minlength=(_N + 1) * self.n)[: _N * self.n].reshape(_N, self.n).astype(np.int32)
        sums = np.cumsum(self.counts, axis=0, dtype=np.int32)
        ends = sums * ((1 << _CLASS) - _N) // sums[-1] + np.arange(1, _N + 1, dtype=np.int32)[:, None]
        self.ends[:] = ends
        size = np.diff(ends, axis=0, prepend=0)
        #: Begin of a class's share, times 8192, and its size.
        self.share = ((ends - size << 13) + size).astype(np.int32).ravel()
        self.since = self.t

    def step(self) -> np.ndarray:
        """The share of the guess ``g`` of 2 ** _FLAG."""
        at = _HASH * self.last
        at[0] += self.before
        at >>= 20
        at &= _SLOTS - 1
        at += self.base
        self.at = at
        e = self.table.take(at, mode="clip")
        self.both = e >> 3
        e &= 7
        self.s = e
        self.g = np.where(e[0] >= e[1], self.both[0], self.both[1])
        at = e[0] << 1
        at += e[1] > 1
        at <<= 1
        at += self.both[0] == self.both[1]
        self.at_sure, self.at_past = self.base_sure + at, self.base_past + self.past
        self.x, self.y = self.sure.take(self.at_sure, mode="clip"), self.of_past.take(self.at_past, mode="clip")
        dot = self.w_sure * self.x
        dot += self.w_past * self.y
        dot >>= 16
        dot += 2047
        self.p = _SQUASH.take(dot, mode="clip")
        return self.p.astype(np.int64)

    def learn(self, ids: np.ndarray, hit: np.ndarray) -> None:
        """Take the ids (int64) of this step; ``hit``: which were guessed."""
        t = self.t
        if t % _LEARNT == 0:
            wrong = hit.astype(np.int32)
            wrong <<= _FLAG
            wrong -= self.p
            if t % _WEIGHED == 0:
                for w, x in ((self.w_sure, self.x), (self.w_past, self.y)):
                    x = x * wrong
                    x >>= 10
                    w += x
                    np.clip(w, 0, 1 << 18, out=w)
            wrong >>= 3
            for logits, at, x in ((self.sure, self.at_sure, self.x), (self.of_past, self.at_past, self.y)):
                x += wrong
                logits[at] = x
        hits = (self.both == ids).view(np.int8)
        e = self.s
        e += hits << 3
        e = _NEXT.take(e, mode="clip")
        e += (ids << 3).astype(np.int32)
        self.table[self.at] = e
        past = self.past
        past &= 7
        past <<= 1
        past += hit
        self.before, self.last = self.last * 40503, ids
        self.t = t = t + 1
        if t in _COUNTED:
            self.refresh(t - self.since)

    def spans(self, ids: np.ndarray, kind: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and size of the ids' intervals, of 2 ** _BITS, and which were guessed."""
        hit = self.g == ids
        at = kind * self.n
        at += self.rows
        e = self.share.take(at, mode="clip").astype(np.int64)
        np.copyto(at, _N * self.n, where=hit)  # ids that order 0 need not code are not counted
        self.seen[self.t - self.since] = at
        missed = ~hit
        rest = (1 << _FLAG) - share
        rest *= missed
        size = e & 8191
        e >>= 13
        e <<= _INNER
        step = _STEP.take(kind, mode="clip")
        place = ids - _FIRST.take(kind, mode="clip")
        place <<= step
        place *= size
        place += e
        place *= rest
        size *= rest
        size <<= step
        share = share << _LOW
        place += share * missed
        size += share * hit
        return place, size, hit


class _Range:
    """Low ends and widths of the blocks' intervals (64 bits)."""

    def __init__(self, n: int) -> None:
        self.low = np.zeros(n, np.uint64)
        self.width = np.full(n, 1 << 63, np.uint64)

    def narrow(self, unit: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        self.low += unit * begin.view(np.uint64)
        self.width = unit * size.view(np.uint64)

    def settle(self, low: np.ndarray, width: np.ndarray, small: np.ndarray | None) -> np.ndarray:
        """The top 16 bits of each interval, once they are the same at both its ends (of those that are ``small``)."""
        word = low >> _TOP
        end = low + width
        end -= _ONE
        end >>= _TOP
        split = end != word
        if small is not None:
            split &= small
        split = np.flatnonzero(split)
        if len(split):
            # The interval holds a multiple of 2 ** 48: go on with its larger side.
            upper = end[split] << _TOP
            under = upper - low[split]
            over = width[split] - under
            width[split] = np.maximum(under, over)
            low[split] = np.where(under >= over, low[split], upper)
            word[split] = low[split] >> _TOP
        return word


def _encode(table: np.ndarray) -> list[bytes]:
    """The code of each row of ids."""
    n, steps = table.shape
    m, r = _Model(n), _Range(n)
    # An id settles at most three words: 37 bits, one lost to rounding and one to each split.
    words, full = np.empty((steps, 3, n), np.uint16), np.zeros((steps, 3, n), bool)
    columns = np.ascontiguousarray(table.T)
    for t, (ids, kind) in enumerate(zip(columns, _KIND[columns], strict=True)):
        ids, kind = ids.astype(np.int64), kind.astype(np.int64)
        begin, size, hit = m.spans(ids, kind, m.step())
        r.narrow(r.width >> np.uint64(_BITS), begin, size)
        small = np.less(r.width, _FLOOR, out=full[t, 0])
        words[t, 0] = r.settle(r.low, r.width, small)
        shift = small * _WORD
        r.low <<= shift
        r.width <<= shift
        some, k = np.flatnonzero(r.width < _FLOOR), 1
        while len(some):
            low, width = r.low[some], r.width[some]
            words[t, k, some], full[t, k, some] = r.settle(low, width, None), True
            width <<= _WORD
            r.low[some], r.width[some] = low << _WORD, width
            some, k = some[width < _FLOOR], k + 1
        m.learn(ids, hit)
    last = r.low + (r.width >> _ONE)
    out = []
    for k in range(0, n, 512):
        used = full[:, :, k : k + 512].reshape(3 * steps, -1).T
        code = words[:, :, k : k + 512].reshape(3 * steps, -1).T[used].astype(">u2")
        ends = np.cumsum(used.sum(1)).tolist()
        out += [code[a:b].tobytes() + x.to_bytes(8, "big") for a, b, x in zip([0, *ends], ends, last[k : k + 512].tolist(), strict=False)]
    return out


def encode_blocks(ids: np.ndarray, size: int = SIZE) -> list[bytes]:
    """The ids (below 65,536) in blocks of ``size``, the last one shorter, each coded by itself.

    A block is its count of ids, the crc32 of its code, and its code.  No ids
    give no blocks.  A shorter last block is coded with zeros after it.
    """
    n = -(-len(ids) // size)
    table = np.zeros((n, size if n > 1 else len(ids)), np.uint16)
    table.ravel()[: len(ids)] = ids
    codes = [code for k in range(0, n, LANES) for code in _encode(table[k : k + LANES])]
    counts = [size] * (n - 1) + [len(ids) - (n - 1) * size]
    return [many.to_bytes(4, "little") + zlib.crc32(code).to_bytes(4, "little") + code for many, code in zip(counts, codes, strict=False)]


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a // b`` for 0 <= a < 2 ** 37 and 0 < b < 2 ** 13, where double precision is exact enough."""
    return (a / b).astype(np.int64)


def _decode(codes: list[bytes], steps: int) -> np.ndarray:
    """Row by row the ids of each code."""
    n = len(codes)
    flat = np.frombuffer(b"".join(codes) + bytes(16), ">u2").astype(np.uint64)
    at = np.concatenate(([0], np.cumsum([len(c) // 2 for c in codes])[:-1])).astype(np.int64)
    code = flat[at] << np.uint64(48) | flat[at + 1] << np.uint64(32) | flat[at + 2] << np.uint64(16) | flat[at + 3]
    at += 4
    m, r = _Model(n), _Range(n)
    out = np.empty((steps, n), np.int32)
    most = np.uint64((1 << _BITS) - 1)
    for t in range(steps):
        share = m.step()
        unit = r.width >> np.uint64(_BITS)
        q = (code - r.low) // unit
        q = np.minimum(q, most).view(np.int64)
        inner = q - (share << _LOW)
        known = inner < 0
        np.maximum(inner, 0, out=inner)
        inner = _quotient(inner, (1 << _FLAG) - share)
        kind = (m.ends <= (inner >> _INNER).astype(np.int16)).view(np.uint8).sum(0, dtype=np.uint8).astype(np.int64)
        np.minimum(kind, _N - 1, out=kind)
        e = m.share.take(kind * n + m.rows, mode="clip").astype(np.int64)
        inner -= e >> 13 << _INNER
        ids = _quotient(inner, e & 8191)
        ids >>= _STEP.take(kind, mode="clip")
        ids += _FIRST.take(kind, mode="clip")
        np.copyto(ids, m.g, where=known)
        ids &= 0xFFFF  # what follows the end of a shorter block may be anything
        kind = _KIND.take(ids, mode="clip").astype(np.int64)
        begin, size, hit = m.spans(ids, kind, share)
        r.narrow(unit, begin, size)
        small = r.width < _FLOOR
        r.settle(r.low, r.width, small)
        shift = small * _WORD
        r.low <<= shift
        r.width <<= shift
        code <<= shift
        next_ = flat.take(at, mode="clip")
        next_ *= small
        code |= next_
        at += small
        some = np.flatnonzero(r.width < _FLOOR)
        while len(some):
            low, width = r.low[some], r.width[some]
            r.settle(low, width, None)
            code[some] = code[some] << _WORD | flat.take(at[some], mode="clip")
            at[some] += 1
            width <<= _WORD
            r.low[some], r.width[some] = low << _WORD, width
            some = some[width < _FLOOR]
        out[t] = ids
        m.learn(ids, hit)
    return out.T


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block, in the order given; ``ValueError`` where a checksum does not hold."""
    sizes = [int.from_bytes(b[:4], "little") for b in blocks]
    for i, b in enumerate(blocks):
        if len(b) < 16 or zlib.crc32(b[8:]) != int.from_bytes(b[4:8], "little"):
            raise ValueError(f"block {i} is damaged")
    out = []
    for k in range(0, len(blocks), LANES):
        part = sizes[k : k + LANES]
        ids = _decode([b[8:] for b in blocks[k : k + LANES]], max(part))
        out += [row[:n].copy() for row, n in zip(ids, part, strict=True)]
    return out
