"""Adaptive context-mixing range coder for token ids, many independent blocks in lockstep.

A block of up to ``BLOCK`` ids is coded alone, from fresh models, and carries a CRC-32 of its ids. For
each id, the order-2 and order-1 contexts (the last two ids, the last id) predict one id each, and the
order-0 model gives every id a share by its count in the block so far. Two adaptive probabilities, by
the predictions' confidence and agreement, are mixed in the logistic domain by weights that learn, into
the probability that the order-2 prediction is right, and if not, that the order-1 one is; what is left
goes to order 0. One range-coder step codes the id from these three. The order-0 shares are renewed from
the counts at set places of a block (``RENEW``).

All arithmetic is on integers, so encoder and decoder agree on every machine. The blocks of a file are
coded together, one id of every block at a time, with numpy over blocks.
"""

from __future__ import annotations

import functools

import numpy as np

#: Ids of a block. Shorter blocks are more lanes to a numpy call and so less time for each id, and learn less.
BLOCK = 3072
#: Places in a block at which the order-0 shares are renewed.
RENEW = (32, 128, 512, 1024, 2048)
#: Bits of the shares of hits and misses, and of the order-0 shares within the misses.
HIT_BITS, ZERO_BITS = 15, 20
SCALE, ZERO = 1 << HIT_BITS, 1 << ZERO_BITS
_ALL_BITS = HIT_BITS + ZERO_BITS
#: The interval has 64 bits, of which 16 leave or enter at a time; it is kept at least _NARROW wide.
_U = np.uint64
_TOP, _WORD, _NARROW, _STEP = _U(48), _U(16), _U(1 << 48), _U(_ALL_BITS)
_BITS1, _BITS2 = 10, 11
_SLOTS1, _SLOTS2 = 1 << _BITS1, 1 << _BITS2
_PART = ZERO_BITS - 10
_PARTS = ZERO >> _PART


@functools.cache
def _curves() -> tuple[np.ndarray, np.ndarray]:
    """Fixed integer tables: stretch (of a 12-bit probability) and squash (of -2048..2047), in 256ths; neither answer is ever sure."""
    p = (np.arange(4096) + 0.5) / 4096
    stretch = np.clip(np.rint(np.log(p / (1 - p)) * 256), -2047, 2047).astype(np.int32)
    squash = np.clip(np.rint(4096 / (1 + np.exp(-np.arange(-2048, 2048) / 256))), 32, 4064).astype(np.int32)
    return stretch, squash


def _ranges(blocks: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, size) of each id of some blocks (a row each) among the order-0 shares in force at its place.

    A share is 1 and a fixed amount for each time the id was seen, so its ends follow from counts of the block's distinct ids.
    """
    lanes, n = blocks.shape
    order = np.argsort(blocks.astype(np.uint16), axis=1, kind="stable")
    order += np.arange(lanes)[:, None] * n
    ids = blocks.ravel()[order]
    new = np.ones((lanes, n), bool)
    np.not_equal(ids[:, 1:], ids[:, :-1], out=new[:, 1:])
    rank = np.empty(lanes * n, np.int64)
    rank[order.ravel()] = np.cumsum(new.ravel()) - 1
    rank = rank.reshape(lanes, n)
    ids, lane = ids[new].astype(np.int32), np.repeat(np.arange(lanes, dtype=np.int32), new.sum(axis=1))
    count = np.zeros(len(ids), np.int32)
    low, size, done = (blocks * (ZERO // width)).astype(np.int32), np.full(blocks.shape, ZERO // width, np.int32), 0
    for seen, end in zip(RENEW, (*RENEW[1:], n), strict=True):
        if seen >= n:
            break
        count += np.bincount(rank[:, done:seen].ravel(), minlength=len(ids)).astype(np.int32)
        share, done = count * np.int32((ZERO - width) // seen), seen
        at = rank[:, seen:end]
        begin = np.cumsum(share, dtype=np.int64) - share
        begin -= lane * (seen * ((ZERO - width) // seen))
        low[:, seen:end] = (ids + begin).astype(np.int32)[at]
        size[:, seen:end] = (share + 1)[at]
    last = blocks == width - 1
    size[last] = ZERO - low[last]
    return low, size


def _runs(block: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of each id of one block."""
    low, size = (x[0].astype(np.int64) for x in _ranges(block[None], width))
    return low, low + size


class _Shares:
    """The order-0 shares of each lane: the distinct ids seen before the last renewal in their order, before them -1 and nothing."""

    def __init__(self, width: int):
        self.width, self.seen = width, 0

    def renew(self, seen: np.ndarray):
        """From the ids of all lanes (places, lanes)."""
        n, lanes = seen.shape
        h = np.full((lanes, n + 1), -1, np.int32)
        h[:, 1:] = np.sort(seen.T, axis=1)
        new = np.ones(h.shape, bool)
        np.not_equal(h[:, 1:], h[:, :-1], out=new[:, 1:])
        at = np.flatnonzero(new)
        lane, place = np.divmod(at, n + 1)
        self.seen, self.spare = n, (ZERO - self.width) // n
        ids, before = h.ravel()[at].astype(np.int64), np.maximum(place - 1, 0)
        upto = np.append(before[1:], 0)  # ids of a lane up to each distinct one
        upto[np.searchsorted(lane, np.arange(lanes), "right") - 1] = n
        low = ids + self.spare * before
        # in one number: low, which is searched and may be -1, how often the id was seen, and the id and 1
        self.packed = (low << 31) + ((upto - before) << 17) + (ids + 1)
        # how many begin before each of _PARTS stretches of the shares, so that a search looks at few
        begun = np.bincount(lane * (_PARTS + 1) + (low >> _PART) + 1, minlength=lanes * (_PARTS + 1))
        self.steps = [1 << k for k in reversed(range(int(begun.reshape(lanes, -1)[:, 1:].max()).bit_length()))]
        self.begun = np.cumsum(begun, dtype=np.int32)

    def find(self, lanes: np.ndarray, target: np.ndarray):
        """(id, low, high) of the shares that hold the targets."""
        last = self.width - 1
        if not self.seen:
            each = ZERO // self.width
            ids = np.minimum(target // each, last)
            return ids, ids * each, np.where(ids == last, ZERO, (ids + 1) * each)
        part = lanes * (_PARTS + 1) + (target >> _PART)
        at, end = self.begun.take(part) - 1, self.begun.take(part + 1) - 1
        limit = (target + 1) << 31
        for step in self.steps:
            probe = np.minimum(at + step, end)
            at = np.maximum(at, probe * (self.packed.take(probe) < limit))
        own = self.packed.take(at)
        ids, low = (own & 0x1FFFF) - 1, own >> 31
        high = low + 1 + self.spare * ((own >> 17) & 0x3FFF)
        past = np.flatnonzero(target >= high)  # of an id not seen, or the last one's rest
        if len(past):
            on = np.minimum(target[past] - high[past], last - 1 - ids[past])
            past, on = past[on >= 0], on[on >= 0]
            ids[past] += on + 1
            low[past] = high[past] + on
            high[past] = low[past] + 1
        high[ids == last] = ZERO
        return ids, low, high


#: What a slot's confidence gains, by the confidence and, from 16 on, where its id was right.
_GAIN = np.array([c // 2 - c for c in range(16)] + [1] * 15 + [0], np.int32)


class _Models:
    """The predictions of orders 2 and 1 in each lane, and how likely they are right; the first m lanes are active.

    Both orders are worked on at once: arrays have the order (2, then 1) before the lane, and for the two probabilities that are
    mixed a place between these. A slot that was never met predicts id 0 at confidence 0.
    """

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.slots = np.zeros(lanes * (_SLOTS2 + _SLOTS1), np.int32)  # 16 * id + confidence
        self.base = np.stack([lane * _SLOTS2, lanes * _SLOTS2 + lane * _SLOTS1])
        self.p = np.full(lanes * 128, 2048, np.int16)
        self.contexts = lane * 128 + np.array([[0, 32], [64, 96]])[:, :, None]
        self.w = np.full((2, 2, lanes), 1 << 15, np.int32)
        self.last, self.last2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)  # hashed

    def predict(self, m: int):
        """(ids of orders 2 and 1, share of an order-2 hit, of any hit)."""
        stretch, squash = _curves()
        last = self.last[:m]
        self.at = np.empty((2, m), np.int64)
        np.add(self.base[0, :m], ((last ^ (self.last2[:m] >> 7)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - _BITS2), out=self.at[0])
        np.add(self.base[1, :m], last >> np.uint32(32 - _BITS1), out=self.at[1])
        self.had = self.slots.take(self.at)
        self.ids, self.conf = self.had >> 4, self.had & 15
        agree = self.ids[0] == self.ids[1]
        self.context = np.empty((2, 2, m), np.int64)
        np.add(self.contexts[:, 0, :m], self.conf + (agree << np.int32(4)), out=self.context[:, 0])
        np.add(self.contexts[:, 1, :m], self.conf[::-1], out=self.context[:, 1])
        self.now = self.p.take(self.context)
        self.s = stretch.take(self.now, mode="clip")
        dot = self.w[:, :, :m] * self.s
        dot = dot[:, 0] + dot[:, 1]
        dot >>= 16
        dot += 2048
        self.out = squash.take(dot, mode="clip")
        first = self.out[0] << (HIT_BITS - 12)
        hits = SCALE - first
        hits *= self.out[1]
        hits >>= 12
        hits *= ~agree  # an order-1 prediction that is the order-2 one needs no share
        hits += first
        return self.ids, first, hits

    def update(self, m: int, ids, hit2, hit1):
        target = np.empty((2, m), np.int16)
        np.left_shift(hit2, np.int16(12), out=target[0])
        np.left_shift(hit1, np.int16(12), out=target[1])
        move = target - self.out
        move *= 6
        move = self.s * move[:, None]
        move >>= 12
        self.w[:, :, :m] += move
        move = target[:, None] - self.now
        move >>= 4
        move += self.now
        self.p[self.context] = move
        sure = self.conf + ((self.ids == ids) << np.int32(4))
        slots = self.had + _GAIN.take(sure, mode="clip")
        slots += (((ids << 4) + 1) - slots) * (sure < 2)
        self.slots[self.at] = slots
        self.last2[:m] = self.last[:m]
        np.multiply(ids.astype(np.uint32), np.uint32(0x9E3779B1), out=self.last[:m])


class _Encoder:
    """The interval of each lane, and its words so far, where carries are added to the word before and passed on in the end."""

    def __init__(self, lanes: int, cap: int):
        self.lo, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.words, self.cap, self.pos = np.zeros(lanes * cap, np.uint32), cap, np.arange(lanes) * cap + 1

    def code(self, m: int, low: np.ndarray, size: np.ndarray):
        """Narrow the first m lanes' intervals to size from low on, of 1 << _ALL_BITS; move whole words."""
        lo, span, pos = self.lo[:m], self.range[:m], self.pos[:m]
        span >>= _STEP
        add = span * low.view(np.uint64)
        span *= size.view(np.uint64)
        lo += add
        self._carry(pos[lo < add])
        self.words[pos] = lo >> _TOP  # written anew where none leaves
        narrow = span < _NARROW
        pos += narrow
        shift = narrow.astype(np.uint64) << _U(4)
        lo <<= shift
        span <<= shift
        at = np.flatnonzero(span < _NARROW)
        while len(at):
            self.words[pos[at]] = lo[at] >> _TOP
            pos[at] += 1
            lo[at] <<= _WORD
            span[at] <<= _WORD
            at = at[span[at] < _NARROW]

    def _carry(self, pos: np.ndarray):
        if len(pos):
            self.words[pos - 1] += np.uint32(1)

    def finish(self) -> list[np.ndarray]:
        """The words of each lane, after one that is free."""
        mid = self.lo + (self.range >> _U(1))
        self._carry(self.pos[mid < self.lo])
        for k in range(4):
            self.words[self.pos + k] = (mid >> _U(48 - 16 * k)) & _U(0xFFFF)
        out = []
        for l, end in enumerate((self.pos + 4).tolist()):
            own = self.words[l * self.cap : end]
            while (over := own >> np.uint32(16)).any():
                own &= np.uint32(0xFFFF)
                own[:-1] += over[1:]
            out.append(own.astype(np.uint16))
        return out


class _Decoder:
    """The interval of each lane, from its own begin on, and where the code lies in it."""

    def __init__(self, words: np.ndarray, pos: np.ndarray):
        self.words, self.pos = words, pos
        self.range, self.x = np.full(len(pos), 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(len(pos), np.uint64)
        for k in range(4):
            self.x = self.x << _WORD | words[pos + k]
        pos += 4

    def target(self, m: int) -> np.ndarray:
        """Where the code lies, of 1 << _ALL_BITS."""
        self.step = self.range[:m] >> _STEP
        return np.minimum(self.x[:m] // self.step, _U((1 << _ALL_BITS) - 1)).view(np.int64)

    def code(self, m: int, low: np.ndarray, size: np.ndarray):
        """As the encoder's, after target."""
        x, span, pos = self.x[:m], self.range[:m], self.pos[:m]
        x -= self.step * low.view(np.uint64)
        np.multiply(self.step, size.view(np.uint64), out=span)
        at = np.flatnonzero(span < _NARROW)
        while len(at):
            p = pos[at]
            x[at] = x[at] << _WORD | self.words.take(p, mode="clip")
            pos[at] = p + 1
            own = span[at] << _WORD
            span[at] = own
            at = at[own < _NARROW]


def _bounds(first, hits, hit2, hit1, zero_low, zero_size):
    """(begin, size) of each id's coded range: a hit's, or its order-0 share of what hits leave. A hit's order-0 share is all of it."""
    hit2, hit1 = hit2.astype(np.int32), hit1.astype(np.int32)
    own, miss = (hits - first) * hit1, 1 - hit2 - hit1
    begin = (first * hit1 + hits * miss).astype(np.int64)
    width = (first * hit2 + own + (SCALE - hits) * miss).astype(np.int64)
    begin <<= ZERO_BITS
    begin += width * zero_low
    width *= zero_size
    return begin, width


def encode(ids: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(ids, words) of each block of BLOCK ids, the last one shorter. The first word is the largest id."""
    n = len(ids)
    if n == 0:
        return []
    if int(ids.max()) >> 16 or int(ids.min()) < 0:
        raise ValueError("ids must be below 65536")
    width = max(2, int(ids.max()) + 1)
    lanes = -(-n // BLOCK)
    rest = n - BLOCK * (lanes - 1)
    coder, models = _Encoder(lanes, BLOCK * 3 + 16), _Models(lanes)  # a step narrows an interval by at most 35 bits and a little
    rows, low, size = (np.zeros((BLOCK, lanes), np.int32) for _ in range(3))
    for l in range(0, lanes - 1, 32):
        some = slice(l, min(l + 32, lanes - 1))
        own = ids[l * BLOCK : some.stop * BLOCK].reshape(-1, BLOCK)
        rows[:, some] = own.T
        low[:, some], size[:, some] = (x.T for x in _ranges(own, width))
    own = ids[(lanes - 1) * BLOCK :]
    rows[:rest, -1] = own
    low[:rest, -1], size[:rest, -1] = (x[0] for x in _ranges(own[None], width))
    for t in range(BLOCK if lanes > 1 else rest):
        m = lanes if t < rest else lanes - 1
        now = rows[t, :m]
        (i2, i1), first, hits = models.predict(m)
        hit2 = now == i2
        hit1 = (now == i1) & ~hit2
        hit = hit2 | hit1
        coder.code(m, *_bounds(first, hits, hit2, hit1, low[t, :m] * ~hit, np.maximum(size[t, :m], hit.astype(np.int32) << ZERO_BITS)))
        models.update(m, now, hit2, hit1)
    out = []
    for l, words in enumerate(coder.finish()):
        words[0] = width - 1
        out.append((BLOCK if l < lanes - 1 else rest, words))
    return out


def decode(blocks: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The ids of all blocks, one after another."""
    if not blocks:
        return np.zeros(0, np.int32)
    size = np.array([n for n, _ in blocks])
    widths = np.array([int(w[0]) + 1 for _, w in blocks])
    if (widths != widths[0]).any():  # blocks of several files
        out = [decode([b]) for b in blocks]
        return np.concatenate(out)
    order = np.argsort(-size, kind="stable")  # active lanes are a prefix
    size = size[order]
    start = np.concatenate([[0], np.cumsum([len(blocks[o][1]) for o in order])])
    words = np.concatenate([*(blocks[o][1] for o in order), np.zeros(8, np.uint16)]).astype(np.uint64)
    coder, models = _Decoder(words, start[:-1] + 1), _Models(len(blocks))
    out, shares = np.zeros((int(size[0]), len(blocks)), np.int32), _Shares(int(widths[0]))
    live = np.searchsorted(-size, -np.arange(int(size[0])), "left")
    for t, m in enumerate(live.tolist()):
        (i2, i1), first, hits = models.predict(m)
        x = coder.target(m)
        part = x >> ZERO_BITS
        hit2 = part < first
        hit = part < hits
        hit1 = hit & ~hit2
        now = i2 * hit2
        now += i1 * hit1
        zero_low, zero_size = np.zeros(m, np.int64), np.full(m, ZERO)
        missed = np.flatnonzero(~hit)
        if len(missed):
            h = hits[missed].astype(np.int64)
            now[missed], begin, end = shares.find(missed, ((x[missed] - (h << ZERO_BITS)).view(np.uint64) // (SCALE - h).view(np.uint64)).view(np.int64))
            zero_low[missed], zero_size[missed] = begin, end - begin
        coder.code(m, *_bounds(first, hits, hit2, hit1, zero_low, zero_size))
        models.update(m, now, hit2, hit1)
        out[t, :m] = now
        if t + 1 in RENEW:
            shares.renew(out[: t + 1])
    back = np.argsort(order, kind="stable")
    return np.concatenate([out[: size[b], b] for b in back.tolist()])
