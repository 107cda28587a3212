"""Word shingles as 64-bit hashes, and parity sketches of their sets, for whole slices of texts.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A document's set holds its distinct 5-word
shingles; with fewer words, the whole sequence as one; without words it is empty.
"""

from __future__ import annotations

import numpy as np

from .pretokens import mix, span_hashes

WIDTH = 5
#: Keys have 48 bits; those of different words that are equal by chance only give pairs that fail the check.
KEY_SHIFT, KEY_BYTES = np.uint64(16), 6
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of each text one after another, offsets of the texts in them)."""
    n = len(offsets) - 1
    raw = _LOWER[raw]
    word = ~_BLANK[raw]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    edge = offsets[:-1][offsets[:-1] < len(raw)]
    begin[edge] = word[edge]
    end = word.copy()
    end[:-1] &= ~word[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = word[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    h = span_hashes(raw, starts, ends)
    first = np.searchsorted(starts, offsets)  # of each text's words
    words = np.diff(first)
    out, at = [], np.zeros(n + 1, np.int64)
    if len(h) >= width:
        rolled = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
        rolled = mix(rolled + np.uint64(width))
    for i in range(n):
        w, a = int(words[i]), int(first[i])
        if w >= width:
            s = np.sort(rolled[a : a + w - width + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif w:
            v = 0
            for x in h[a : a + w].tolist():
                v = (v * 0x9E3779B97F4A7C15 + x) & 0xFFFFFFFFFFFFFFFF
            s = mix(np.array([v + w & 0xFFFFFFFFFFFFFFFF], np.uint64))
        else:
            s = np.zeros(0, np.uint64)
        out.append(s)
        at[i + 1] = at[i] + len(s)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), at


def level(size: np.ndarray) -> np.ndarray:
    """The size band: floor(log2(size))."""
    return np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1


def sketch_bits(lv: int) -> int:
    return max(64, 4 << lv)


def sketches(sets: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Each set's parity sketch: bit i is the parity of the number of hashes that fall on it.

    It has 4 bits for each hash of the smallest set of the size band; folding a sketch in halves gives
    that of the next smaller band, so that sketches of neighbouring bands can be compared.
    """
    size = np.diff(at)
    bits = np.array([sketch_bits(x) for x in level(size).tolist()], np.int64)
    base = np.concatenate([[0], np.cumsum(bits)])
    doc = np.repeat(np.arange(len(size)), size)
    pos = base[doc] + (sets & (bits[doc] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(pos, minlength=base[-1]) & 1).astype(bool)).tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch (its words along the last axis) folded to a smaller number of words."""
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def reach(size, percent: int):
    """The largest symmetric difference that a set of this size can have with a set it links to.

    With J >= percent/100 =: t the difference is at most (a + b)(1 - t) / (1 + t), and b at most a / t.
    """
    return (size * (100 - percent)) // percent


def segment_keys(sets: np.ndarray, at: np.ndarray, percent: int, down: bool, last=None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, set of each key): the pigeonhole keys in the set's own size band, or with down in the next smaller one.

    The hash space is cut into K segments. A segment's 64-bit parity word is the XOR of its hashes, its key 48 bits of a mix of that; two
    sets that differ in at most d hashes agree in at least K - d of the K words. Under any fixed order of
    words, the first d + 1 words of each then have one in common. Words for which ``last`` (a function of
    their keys) is true come last in that order, fuller segments first, as they are shared by chance
    least; empty ones are used only where nothing else is left. Without ``last`` all filled ones are given.
    """
    size = np.diff(at)
    lv = level(size) - (1 if down else 0)
    take = reach(size, percent) + 1
    # the largest set of a pair of bands (2^(lv+1) - 1 for the smaller member) fixes K
    top = reach((2 << np.maximum(lv, 0)) - 1, percent) + 1
    k = np.maximum(top + (top * 3) // 10 + 1, 2).astype(np.int64)
    use = size > 0
    if down:
        use &= (lv >= 0) & (size * percent <= 100 * ((2 << np.maximum(lv, 0)) - 1))
    doc = np.repeat(np.arange(len(size)), size)
    picked = use[doc]
    doc, e = doc[picked], sets[picked]
    seg = ((e >> np.uint64(32)) * k[doc].astype(np.uint64) >> np.uint64(32)).astype(np.int64)  # ascending within a set
    if len(e) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    run = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (seg[1:] != seg[:-1])]))
    word = np.bitwise_xor.reduceat(mix(e + np.uint64(0x632BE59BD9B4E019)), run)
    count = np.diff(np.append(run, len(e)))
    rdoc, rseg = doc[run], seg[run]
    tag = mix(rseg.astype(np.uint64) * np.uint64(64) + lv[rdoc].astype(np.uint64))
    key = mix(word ^ tag) >> KEY_SHIFT
    if last is None:
        return key, rdoc
    order = (rdoc.astype(np.uint64) << np.uint64(40)) | (last(key).astype(np.uint64) << np.uint64(39)) | ((np.uint64(127) - np.minimum(count, 127).astype(np.uint64)) << np.uint64(32)) | (key >> np.uint64(16))
    order = np.argsort(order, kind="stable")
    key, rdoc = key[order], rdoc[order]
    filled = np.bincount(rdoc, minlength=len(size))
    rank = np.arange(len(key)) - np.repeat(np.cumsum(filled) - filled, filled)
    keep = rank < take[rdoc]
    keys, docs = [key[keep]], [rdoc[keep]]
    # sets with fewer filled segments than words to take: empty segments, in order of their tag
    for d in np.flatnonzero(use & (filled < np.minimum(take, k))).tolist():
        empty = np.setdiff1d(np.arange(k[d]), seg[doc == d])
        tags = np.sort(mix(mix(empty.astype(np.uint64) * np.uint64(64) + np.uint64(lv[d]))) >> KEY_SHIFT)
        more = tags[: int(take[d] - filled[d])]
        keys.append(more)
        docs.append(np.full(len(more), d))
    return np.concatenate(keys), np.concatenate(docs)
