"""The byte-level pre-tokenizer and a fast id encoder, vectorised over whole slices of text.

``boundaries`` marks where the pieces of the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` begin. The
pattern is locally testable: whether a byte begins a piece depends on at most three characters
around it, so that no sequential scan is needed.

``IdEncoder`` encodes every distinct piece of a slice once with the tokenizers library and gathers
the ids of all pieces from there, which gives the library's ids at many times its speed.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import regex
import xxhash

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
SPECIAL = "<|endoftext|>"
_MULT = 0x9E3779B97F4A7C15 | 1
_LONG = 48


@functools.cache
def class_table() -> np.ndarray:
    """The class of each code point, from the Unicode properties of the regex module."""
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        match = regex.compile(f"{pattern}+").finditer
        for base in (0, 0xE000):
            top = 0xD800 if base == 0 else 0x110000
            for m in match("".join(map(chr, range(base, top)))):
                table[base + m.start() : base + m.end()] = kind
    table[0x1C:0x20] = OTHER  # the pattern's white space is the Unicode property, without the separators 1C to 1F
    return table


@functools.cache
def _ascii_table() -> np.ndarray:
    return np.concatenate([class_table()[:128], np.full(128, OTHER, np.uint8)])


def byte_classes(raw: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    kind = _ascii_table()[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        pad = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.uint32)
        b0, b1, b2, b3 = (pad[lead + k] for k in range(4))
        two, three = b0 < 0xE0, b0 < 0xF0
        cp = np.where(two, (b0 & 31) << 6 | b1 & 63, np.where(three, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63))
        own = class_table()[np.minimum(cp, 0x10FFFF)]
        kind[lead] = own
        kind[lead + 1] = own
        more = ~two
        kind[lead[more] + 2] = own[more]
        most = ~three
        kind[lead[most] + 3] = own[most]
    return kind


def boundaries(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True at each byte where a piece begins; offsets are the texts' starts and the end."""
    n = len(raw)
    kind = byte_classes(raw)
    begin = np.zeros(n + 4, bool)  # of texts; one behind the end too
    begin[offsets] = True
    first = begin[:n]
    prev = np.empty(n, np.uint8)
    prev[0:1] = OTHER
    prev[1:] = kind[:-1]
    prev_byte = np.empty(n, np.uint8)
    prev_byte[0:1] = 0
    prev_byte[1:] = raw[:-1]
    space = kind == SPACE
    start = (kind != prev) | first
    # a blank before another character belongs to it
    glued = start & (prev_byte == 32) & ~space & ~first
    start[glued] = False
    at = np.flatnonzero(space)
    if len(at):
        lead = raw[at] < 0x80
        lead |= raw[at] >= 0xC0
        at = at[lead]
        width = np.where(raw[at] < 0x80, 1, np.where(raw[at] < 0xE0, 2, 3))
        nxt = at + width
        ends = begin[nxt] | (nxt >= n)
        after = np.full(len(at), SPACE, np.uint8)
        ok = ~ends
        after[ok] = kind[nxt[ok]]
        start[at[ok & (after != SPACE)]] = True  # the last white space before another character stands alone or is glued to it
    quote = np.flatnonzero((raw == 39) & (first | ((prev != OTHER) & (prev_byte != 32))))
    if len(quote):
        pad = np.concatenate([raw, np.zeros(4, np.uint8)])
        a, b = pad[quote + 1], pad[quote + 2]
        in1, in2 = ~begin[quote + 1], ~begin[np.minimum(quote + 2, n + 3)]
        one = in1 & np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = in1 & in2 & (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108))
        for hit, width in ((quote[one], 2), (quote[two & ~one], 3)):
            start[hit + 1] = False
            nxt = hit + width
            nxt = nxt[nxt < n]
            # what follows a contraction begins a piece, but for a continued white space or glue handled above
            start[nxt] = True
    start[offsets[:-1][offsets[:-1] < n]] = True
    return start


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.uint64(_MULT)
    inv = np.uint64(pow(_MULT, -1, 1 << 64))
    out = []
    for x in (m, inv):
        p = np.full(n + 1, x, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; long spans by a hash of their own bytes."""
    n = len(raw)
    size = 1 << max(16, (max(n, 1) - 1).bit_length())
    pw, ipw = _powers(size)
    acc = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * pw[:n], out=acc[1:])
    length = (ends - starts).astype(np.uint64)
    h = mix((acc[ends] - acc[starts]) * ipw[starts] + length * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(length > _LONG):
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes())
    return h


def factorize(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each value's first equal one, the distinct values), in order of appearance."""
    coded = pa.array(values).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_numpy()


def release() -> None:
    """Drop the tables that depend on the length of texts; a task that ends calls it."""
    _powers.cache_clear()


def forget() -> None:
    """Drop what encoders keep in this worker; operators that encode nothing call it for the memory."""
    encoder.cache_clear()
    tokenizer.cache_clear()
    piece_tokenizer.cache_clear()


@functools.cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def byte_letters() -> np.ndarray:
    """The letter that a byte-level vocabulary writes for each byte, as UTF-16 units."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = np.zeros(256, "<u2")
    letters[own] = own
    letters[np.setdiff1d(np.arange(256), own)] = 256 + np.arange(256 - len(own))
    return letters


@functools.cache
def piece_tokenizer(path: str):
    """The library's tokenizer on the same model, for lines of pieces: takes byte letters and divides at line ends only."""
    from tokenizers import Tokenizer, pre_tokenizers

    own = Tokenizer(tokenizer(path).model)
    own.pre_tokenizer = pre_tokenizers.Split(chr(byte_letters()[10]), "isolated")
    return own


class IdEncoder:
    """Ids of whole texts as the tokenizers library gives them, without special tokens added."""

    LIMIT = 600_000  # distinct pieces kept, some 40 bytes each; beyond, the memory starts anew

    def __init__(self, path: str):
        self.tok, self.lines = tokenizer(path), piece_tokenizer(path)
        self.limit = self.LIMIT
        self.newline = self.tok.encode("\n", add_special_tokens=False).ids[0]
        self.clear()

    def clear(self) -> None:
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes, number of each one's piece
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = self.pieces = 0
        self.off, self.len = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def _add(self, keys: np.ndarray, pieces: list[bytes]) -> np.ndarray:
        """Encode new pieces, those without line ends in one text, a line each; returns their numbers."""
        lined = [b"\n" not in p for p in pieces]
        split = np.asarray(lined, bool)
        numbers = np.where(split, np.cumsum(split), len(keys) - np.cumsum(~split[::-1])[::-1] + 1) - 1 + self.pieces
        keys = np.concatenate([keys[split], keys[~split]])
        text = np.frombuffer(b"\n".join([p for p, x in zip(pieces, lined, strict=True) if x] + [b""]), np.uint8)
        text = byte_letters()[text].tobytes().decode("utf-16-le")
        ids = np.asarray(self.lines.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        cut = np.flatnonzero(ids == self.newline)
        if len(cut) != sum(lined):
            raise AssertionError("a piece holds a line end")
        blank = self.tok.encode_batch([p.decode() for p, x in zip(pieces, lined, strict=True) if not x], add_special_tokens=False)
        lens = np.concatenate([np.diff(cut, prepend=-1) - 1, [len(e.ids) for e in blank]]).astype(np.int64)
        ids = np.concatenate([np.delete(ids, cut), *(np.asarray(e.ids, np.int32) for e in blank)])
        at = self.pieces
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while at + len(keys) > len(self.off):
            self.off, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.off, self.len))
        self.ids[self.used : self.used + len(ids)] = ids
        self.len[at : at + len(keys)] = lens
        self.off[at : at + len(keys)] = self.used + np.cumsum(lens) - lens
        self.used += len(ids)
        self.pieces += len(keys)
        order = np.argsort(keys)
        where = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, where, keys[order])
        self.entry = np.insert(self.entry, where, at + order.astype(np.int32))
        return numbers

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's piece, -1 where it is not known."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        order = np.argsort(keys)  # neighbours are searched faster
        at = np.empty(len(keys), np.int64)
        at[order] = np.minimum(np.searchsorted(self.keys, keys[order]), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.entry[at], -1)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of the texts in them)."""
        n = len(offsets) - 1
        if len(raw) == 0:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        if SPECIAL.encode() in raw.tobytes():  # the library takes such texts apart itself
            got = [e.ids for e in self.tok.encode_batch([raw[offsets[i] : offsets[i + 1]].tobytes().decode() for i in range(n)], add_special_tokens=False)]
            out = np.concatenate([np.asarray(x, np.int32) for x in got])
            return out, np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)
        starts = np.flatnonzero(boundaries(raw, offsets))
        ends = np.append(starts[1:], len(raw))
        keys = span_hashes(raw, starts, ends)
        codes, distinct = factorize(keys)
        if self.pieces + len(distinct) > self.limit:
            self.clear()
        found = self._find(distinct)
        new = np.flatnonzero(found < 0)
        if len(new):
            where = np.full(len(distinct), -1, np.int64)
            where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            at = where[new]
            found[new] = self._add(distinct[new], [raw[p:q].tobytes() for p, q in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        entry = found[codes]
        lens = self.len[entry]
        total = np.concatenate([[0], np.cumsum(lens)])
        ids = self.ids[np.repeat(self.off[entry] - total[:-1], lens) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]


@functools.cache
def encoder(path: str) -> IdEncoder:
    """One per Python worker."""
    return IdEncoder(path)
