"""Token counts by finite-state tokenizer compilation.

The merges of a byte-level BPE vocabulary are compiled into a deterministic transducer over bytes:
each transition carries the change of the number of tokens that the piece read so far has. Its states
hold what decides the future: the longest suffix that begins some token, and the last token and the
relative count at each place in that suffix from which a token may still grow. An appended byte ends
in the one token that is compatible with the token before it, so each state has one successor per
byte. Transitions are determinised when they are first met and kept per Python worker.

Texts are cut into chunks of a fixed length. What a chunk does to the state is a map: after the
chunk's first piece boundary it is constant, before it depends on the state the chunk is entered in.
All constant parts run in lockstep first; then the heads, from all states that they may be entered in;
the heads' maps are composed in a parallel prefix scan by doubling, and a segmented prefix sum adds up the
counts.

Null and empty texts have 0 tokens. Special tokens' strings inside texts count as the library's
default has it: one token each. Other columns are not read and their names cannot clash.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, text_buffers
from .pretokens import SPECIAL, boundaries, tokenizer

CHUNK = 512
#: Bytes before a chunk from which the state that it is entered in is guessed.
WARM = 64
#: Bytes of text whose chunks are read in lockstep.
LANE_BYTES = 1 << 20


def _byte_chars() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Transducer:
    """The counting transducer of one byte-level BPE vocabulary; state 0 is the start of a piece."""

    LIMIT, PAIRS = 150_000, 1_000_000  # states and pairs of tokens kept; beyond, the tables start anew

    def __init__(self, path: str):
        self.model = tokenizer(path).model
        chars = _byte_chars()
        back = {c: b for b, c in chars.items()}
        self.chars = chars
        self.vocab = {}
        for token, i in tokenizer(path).get_vocab(with_added_tokens=False).items():
            if all(c in back for c in token):
                self.vocab[bytes(back[c] for c in token)] = i
        self.prefixes = {t[:k] for t in self.vocab for k in range(len(t) + 1)}
        self.valid: dict[tuple[bytes, bytes], bool] = {}
        self.alphabet = np.full(256, -1, np.int16)
        self.letters = 0
        self.clear()

    def clear(self) -> None:
        self.number: dict = {}
        self.known: list = []
        self.next = np.full((1 << 12, 160), -1, np.int32)
        self.delta = np.zeros((1 << 12, 160), np.int8)
        self.intern((b"", ((0, b"", 0),)))

    def intern(self, key) -> int:
        i = self.number.get(key)
        if i is None:
            i = self.number[key] = len(self.known)
            self.known.append(key)
            if i >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.delta = np.concatenate([self.delta, np.zeros_like(self.delta)])
        return i

    def compatible(self, left: bytes, right: bytes) -> bool:
        """Whether the encoding of left + right is these two tokens; left may be empty."""
        got = self.valid.get((left, right))
        if got is None:
            ids = [x.id for x in self.model.tokenize("".join(self.chars[b] for b in left + right))]
            want = [self.vocab[x] for x in (left, right) if x]
            got = self.valid[left, right] = ids == want
        return got

    def step(self, state: int, byte: int) -> tuple[int, int]:
        suffix, places = self.known[state]
        b = bytes([byte])
        for at, last, rel in places:  # longest token first; exactly one fits
            token = suffix[at:] + b
            if token in self.vocab and self.compatible(last, token):
                delta = rel + 1
                break
        else:
            raise ValueError(f"the vocabulary cannot encode byte {byte}")
        grown = suffix + b
        kept = [(at, last, rel - delta) for at, last, rel in places if grown[at:] in self.prefixes]
        cut = kept[0][0] if kept else len(grown)
        places = (*((at - cut, last, rel) for at, last, rel in kept), (len(grown) - cut, token, 0))
        return self.intern((grown[cut:], places)), delta

    def fill(self, states: np.ndarray, codes: np.ndarray, raw_bytes: np.ndarray) -> None:
        """Determinise the transitions that are still missing among these."""
        for s, c, b in {(int(s), int(c)): (int(s), int(c), int(b)) for s, c, b in zip(states, codes, raw_bytes, strict=True)}.values():
            to, delta = self.step(s, b)  # may replace the tables
            self.next[s, c], self.delta[s, c] = to, delta

    def letters_of(self, raw: np.ndarray) -> np.ndarray:
        codes = self.alphabet[raw]
        if (codes < 0).any():
            for b in np.unique(raw[codes < 0]).tolist():
                self.alphabet[b] = self.letters
                self.letters += 1
            if self.letters > self.next.shape[1]:
                wide = 256 - self.next.shape[1]
                self.next = np.concatenate([self.next, np.full((len(self.next), wide), -1, np.int32)], 1)
                self.delta = np.concatenate([self.delta, np.zeros((len(self.delta), wide), np.int8)], 1)
            codes = self.alphabet[raw]
        return codes

    def run(self, raw: np.ndarray, codes: np.ndarray, fresh: np.ndarray, lo: np.ndarray, hi: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read bytes lo..hi of each lane in lockstep from the lane's state; (exit states, net counts)."""
        count = np.zeros(len(lo), np.int64)
        state = state.copy()
        order = np.argsort(lo - hi, kind="stable")  # longest lanes first, so that the active ones are a prefix
        lo, hi = lo[order], hi[order]
        s, n = state[order], np.zeros(len(lo), np.int64)
        live = np.searchsorted(lo - hi, -np.arange(int((hi - lo).max(initial=0))), "left")
        for k, m in enumerate(live.tolist()):
            at = lo[:m] + k
            now = s[:m]
            now[fresh[at]] = 0
            c = codes[at]
            to = self.next[now, c]
            miss = to < 0
            if miss.any():
                self.fill(now[miss], c[miss], raw[at[miss]])
                to = self.next[now, c]
            n[:m] += self.delta[now, c]
            s[:m] = to
        state[order], count[order] = s, n
        return state, count

    def heads(self, raw: np.ndarray, codes: np.ndarray, fresh: np.ndarray, lo: np.ndarray, reset: np.ndarray, whole: np.ndarray, leave: np.ndarray) -> np.ndarray:
        """Net counts of the chunks' heads (lo to reset); whole chunks have no boundary and hand their state on.

        A head's map is held for the states that it may be entered in: the state that the chunk before leaves
        for certain, or, where that is whole, those that its own map gives, and the one that its last bytes
        lead to from the start of a piece. Maps grow until each state that leaves a whole chunk has an entry in
        the next one; as tokenizations of the same bytes soon agree, that takes few rounds. The maps'
        entries then are arrays of links to the next chunk's entries, which are composed by doubling.
        """
        out = np.zeros(len(lo), np.int64)
        head = np.flatnonzero(reset > lo)
        if not len(head):
            return out
        behind = whole[head - 1] & (reset[head - 1] > lo[head - 1])  # behind a whole chunk
        first, later = head[~behind], head[behind]
        known = first << 32 | leave[first - 1]
        todo, roots = known, np.unique(known)
        if len(later):
            warm = np.maximum(reset[later - 1] - WARM, lo[later - 1])
            guess, _ = self.run(raw, codes, fresh, warm, reset[later - 1], np.zeros(len(later), np.int64))
            todo = np.concatenate([todo, later << 32 | guess])
        keys = exits = nets = np.zeros(0, np.int64)
        has_head = np.zeros(len(lo) + 1, bool)
        has_head[head] = True
        while len(todo):  # entries (chunk, state) that have not been run yet
            todo = np.unique(todo)
            chunk, state = todo >> 32, todo & 0xFFFFFFFF
            leaves, net = self.run(raw, codes, fresh, lo[chunk], reset[chunk], state)
            on = whole[chunk] & has_head[chunk + 1]
            link = np.where(on, (chunk + 1) << 32 | leaves, -1)
            order = np.argsort(np.concatenate([keys, todo]), kind="stable")
            keys, exits, nets = (np.concatenate(x)[order] for x in ((keys, todo), (exits, link), (nets, net)))
            todo = np.setdiff1d(link[on], keys)
        jump = np.where(exits < 0, len(keys), np.searchsorted(keys, exits))
        jump = np.append(jump, len(keys))  # the end leads to itself
        real = np.zeros(len(keys) + 1, bool)
        real[np.searchsorted(keys, roots)] = True
        for _ in range(int(len(lo)).bit_length()):
            real[jump[real.nonzero()[0]]] = True
            jump = jump[jump]
        at = np.flatnonzero(real[:-1])
        out[keys[at] >> 32] = nets[at]
        return out

    def counts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        n = len(raw)
        if n == 0:
            return np.zeros(len(offsets) - 1, np.int64)
        if len(self.known) > self.LIMIT:
            self.clear()
        if len(self.valid) > self.PAIRS:
            self.valid = {}
        codes, fresh = self.letters_of(raw), boundaries(raw, offsets)
        starts = np.flatnonzero(fresh)
        lens = np.diff(offsets)
        chunks = -(-lens // CHUNK)
        doc = np.repeat(np.arange(len(lens)), chunks)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        lo = offsets[doc] + within * CHUNK
        hi = np.minimum(lo + CHUNK, offsets[doc + 1])
        nxt = np.searchsorted(starts, lo)
        reset = np.minimum(np.append(starts, n)[nxt], hi)  # where the chunk's map becomes constant
        zero = np.zeros(len(lo), np.int64)
        leave, count = self.run(raw, codes, fresh, reset, hi, zero)
        count += self.heads(raw, codes, fresh, lo, reset, reset == hi, leave)
        total = np.concatenate([[0], np.cumsum(count)])
        ends = np.cumsum(chunks)
        return total[ends] - total[ends - chunks]


@functools.cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


def _split_special(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Texts taken apart at special strings: (bytes, offsets, row of each part, special tokens of each row)."""
    mark = SPECIAL.encode()
    if mark not in raw.tobytes():
        return None
    parts, row, extra = [], [], np.zeros(len(offsets) - 1, np.int64)
    for i in range(len(offsets) - 1):
        got = raw[offsets[i] : offsets[i + 1]].tobytes().split(mark)
        parts += got
        row += [i] * len(got)
        extra[i] = len(got) - 1
    off = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), off, np.asarray(row), extra


def count_column(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of each text of an Arrow column."""
    raw, offsets = text_buffers(column)
    out = np.zeros(len(column), np.int64)
    machine = transducer(path)
    for i, j in slices(offsets, LANE_BYTES):
        part, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if apart := _split_special(part, off):
            out[i:j] = np.bincount(apart[2], machine.counts(*apart[:2]), j - i).astype(np.int64) + apart[3]
        else:
            out[i:j] = machine.counts(part, off)
    return np.diff(offsets), out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit. See the module's docstring for nulls and special strings."""

    def run(batches):
        for b in batches:
            n_bytes, n_tokens = count_column(b.column(1), path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return rows.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
