"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased; runs of other characters than letters become one blank. For each language an
interpolated Kneser-Ney model of order ``ORDER`` over characters is trained. The models are compiled
into one sorted array of 64-bit n-gram hashes per order, with a column of log probabilities per
language, and one of context hashes with the back-off weights. A text's cross-entropy under each
language is divided by its length; the lowest wins.

The score is the posterior of the winner at a temperature fitted on documents kept apart from
training. A text is rejected if it has no letter, or if it is in none of the languages. Its excess is the
cross-entropy beyond the most that any of those documents had under its own language and ``margin``
bits more, times its symbols; it is in none if that is more bits than any labelled row of the input has
whose label is its winner, and more than ``SIGNIFICANT``. So a short text with an odd word stays, and so
does every labelled row that is found to be of its language.

Training uses at most about ``docs_per_lang`` whole documents of each language, chosen by a hash of
the id (a documented bound; languages are at most ``MAX_LANGS``). Every document is scored whole. Null
and letterless texts are ``und`` with score 0, as are all texts where nothing can be learned. Rows
without a label or id are not learned from; those without an id still count for the excess. Repeated
rows are scored alike. Columns besides id, text and label are not read, and the label is read for
training and the excess only.
"""

from __future__ import annotations

import dataclasses
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, text_buffers
from .pretokens import LETTER, class_table, factorize, forget, mix

ORDER, DOCS_PER_LANG, MAX_LANGS = 4, 600, 500
#: Bytes of text scored at once.
SLICE = 1 << 19
#: Bits of excess that are no evidence yet, and what sums in another order may differ by.
SIGNIFICANT, ROUNDING = 64.0, 0.01
BLANK = 32
UNKNOWN = "und"


@functools.cache
def lower_table() -> np.ndarray:
    table = np.full(0x110000, BLANK, np.int32)
    for cp in np.flatnonzero(class_table() == LETTER).tolist():
        low = chr(cp).lower()
        table[cp] = ord(low) if len(low) == 1 else cp
    return table


def symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, offsets of the texts in them); each text starts with a blank."""
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    sym = np.insert(lower_table()[points], at[:-1], BLANK).astype(np.int64)
    at = at + np.arange(len(at))
    letter = sym != BLANK
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[at[:-1]] = True
    return sym[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def histories(sym: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each position the symbol and those before it, newest first; 0 before the text."""
    pos = np.arange(len(sym)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = [sym]
    for k in range(1, ORDER):
        past = np.zeros_like(sym)
        past[k:] = sym[:-k] if k < len(sym) else 0
        out.append(np.where(pos >= k, past, 0))
    return out


def chain(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the newest 0, 1, 2, ... symbols."""
    out = [np.full(len(columns[0]), 0x51ED270B, np.uint64)]
    for c in columns:
        out.append(mix(out[-1] * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1)))
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions in a sorted hash array, -1 where absent."""
    if len(keys) == 0:
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclasses.dataclass
class Models:
    langs: list[str]
    floor: float  # log2 of the uniform distribution
    grams: list[tuple[np.ndarray, np.ndarray]]  # by order - 1: sorted hashes, log2 probabilities by language
    contexts: list[tuple[np.ndarray, np.ndarray]]  # by order - 1: sorted hashes, log2 back-off weights by language
    temperature: float = 1.0
    limits: np.ndarray | None = None
    allowed: np.ndarray | None = None  # bits of excess by language

    def log_probs(self, k: int, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """log2 P of each n-gram of order k under each language; grams and contexts are hash chains."""
        if k == 0:
            return np.full((len(grams[0]), len(self.langs)), self.floor)
        keys, values = self.grams[k - 1]
        at = _find(keys, grams[k])
        out = values[at] if len(keys) else np.zeros((len(at), len(self.langs)))
        rest = np.flatnonzero(at < 0)
        if len(rest):
            back = self.log_probs(k - 1, [g[rest] for g in grams], [c[rest] for c in contexts])
            keys, values = self.contexts[k - 1]
            at = _find(keys, contexts[k - 1][rest])
            seen = at >= 0
            back[seen] += values[at[seen]]
            out[rest] = back
        return out

    def entropies(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits per symbol under each language, symbols without the leading blank) of each text."""
        n = len(offsets) - 1
        sym, at = symbols(raw, offsets)
        count = np.diff(at) - 1
        total = np.zeros((n, len(self.langs)))
        if len(sym):
            cols = histories(sym, at)
            scored = np.ones(len(sym), bool)
            scored[at[:-1]] = False
            full = functools.reduce(lambda h, c: mix(h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1)), cols, np.full(len(sym), 7, np.uint64))
            codes, distinct = factorize(full)
            first = np.zeros(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            own = [c[first] for c in cols]
            value = -self.log_probs(ORDER, chain(own), chain(own[1:]))
            for j in range(len(self.langs)):
                run = np.concatenate([[0.0], np.cumsum(np.where(scored, value[codes, j], 0.0))])
                total[:, j] = run[at[1:]] - run[at[:-1]]
        return total / np.maximum(count, 1)[:, None], count

    def decide(self, entropy: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(winner, score, its bits per symbol, rejected)."""
        best = entropy.argmin(1)
        low = entropy[np.arange(len(best)), best]
        gap = (entropy - low[:, None]) * (np.log(2) * self.temperature * np.maximum(count, 1)[:, None])
        score = 1.0 / np.exp(-np.minimum(gap, 700.0)).sum(1)
        far = np.zeros(len(best), bool)
        if self.limits is not None:
            allowed = np.full(len(self.langs), SIGNIFICANT) if self.allowed is None else self.allowed
            far = self.excess(best, low, count) > allowed[best]
        return best, score, low, (count <= 0) | far

    def excess(self, best: np.ndarray, low: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Bits of each text beyond what its winner's limit gives to its symbols."""
        return (low - self.limits[best]) * count


def train(counts, langs: list[str]) -> Models:
    """Kneser-Ney models from top-order n-gram counts, a pandas table: columns lang, s0 (newest) .. s{ORDER-1}, n."""
    names = [f"s{i}" for i in range(ORDER)]
    vocab = counts["s0"].nunique() + 1
    model = Models(langs, -float(np.log2(vocab)), [], [])
    own = {ORDER: {x: counts[counts["lang"] == x][[*names, "n"]].reset_index(drop=True) for x in langs}}
    for k in range(ORDER - 1, 0, -1):  # how many different symbols stand before each shorter n-gram
        own[k] = {x: t.groupby(names[:k], as_index=False).agg(n=("n", "size")) for x, t in own[k + 1].items()}
    for k in range(1, ORDER + 1):
        contexts, parts = {}, {}
        for x in langs:
            t = own[k][x]
            once, twice = int((t["n"] == 1).sum()), int((t["n"] == 2).sum())
            d = once / (once + 2 * twice) if once else 0.5
            d = min(max(d, 0.1), 0.95)
            ctx = t.groupby(names[1:k]) if k > 1 else t.assign(_=0).groupby("_")
            total, types = ctx["n"].transform("sum"), ctx["n"].transform("size")
            cols = [t[c].to_numpy() for c in names[:k]]
            gram, before = chain(cols), chain([*cols[1:], np.zeros(len(t), np.int64)])
            weight = np.log2(d * types / total).to_numpy(float)
            parts[x] = (gram, before, ((t["n"] - d) / total).to_numpy(float), weight)
            key, at = np.unique(before[k - 1], return_index=True)
            contexts[x] = (key, weight[at])
        keys = np.unique(np.concatenate([c[0] for c in contexts.values()]))
        table = np.zeros((len(keys), len(langs)))
        for j, x in enumerate(langs):
            table[np.searchsorted(keys, contexts[x][0]), j] = contexts[x][1]
        model.contexts.append((keys, table))
        grams = [np.concatenate([parts[x][0][i] for x in langs]) for i in range(k + 1)]
        before = [np.concatenate([parts[x][1][i] for x in langs]) for i in range(k + 1)]
        keys, at = np.unique(grams[k], return_index=True)
        model.grams.append((np.zeros(0, np.uint64), np.zeros((0, len(langs)))))
        backed = model.log_probs(k, [g[at] for g in grams], [b[at] for b in before])  # backed off, as no n-gram of order k is known yet
        for j, x in enumerate(langs):
            gram, _, direct, _ = parts[x]
            i = np.searchsorted(keys, gram[k])
            backed[i, j] = np.log2(direct + np.exp2(backed[i, j]))
        model.grams[-1] = (keys, backed)
    return model


def _sample(docs: DataFrame, docs_per_lang: int) -> tuple[DataFrame, list[str]]:
    """id, text, lang, held of about docs_per_lang labelled documents of each language; held ones calibrate."""
    h = F.pmod(F.xxhash64(F.lit(29), F.col("id").cast("string")), F.lit(1 << 30))
    known = docs.where(F.col("id").isNotNull() & F.col("lang").isNotNull())
    counts = known.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError("too many languages")
    line = F.lit(0)
    for r in counts:
        line = F.when(F.col("lang") == r["lang"], F.lit(min(1 << 30, int((1 << 30) * docs_per_lang / r["count"]) + 1))).otherwise(line)
    picked = known.where(h < line).withColumn("held", F.pmod(F.xxhash64(F.lit(31), F.col("id").cast("string")), F.lit(6)) == 0)
    return picked, sorted(r["lang"] for r in counts)


def _count_grams(batches):
    names = [f"s{i}" for i in range(ORDER)]
    for b in batches:
        langs = np.asarray(b.column(1).to_pylist(), object)
        raw, offsets = text_buffers(b.column(0))
        for i, j in slices(offsets, SLICE):
            sym, at = symbols(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            keep = np.ones(len(sym), bool)
            keep[at[:-1]] = False
            cols = [pa.array(c[keep]) for c in histories(sym, at)]
            t = pa.Table.from_arrays([pa.array(np.repeat(langs[i:j], np.diff(at))[keep], pa.string()), *cols], ["lang", *names])
            t = t.group_by(["lang", *names]).aggregate([([], "count_all")]).rename_columns({"count_all": "n"}).select(["lang", *names, "n"])
            yield from t.combine_chunks().to_batches()


def _entropies(model):
    def run(batches):
        for b in batches:
            raw, offsets = text_buffers(b.column(0))
            for i, j in slices(offsets, SLICE):
                e, n = model.value.entropies(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), pa.array(list(e), pa.list_(pa.float64())), pa.array(n, pa.int64())], ["lang", "e", "n"])

    return run


def _most_excess(model):
    """The most excess of the rows of a batch whose label is their winner, by language."""

    def run(batches):
        forget()
        langs = np.asarray(model.value.langs, object)
        for b in batches:
            raw, offsets = text_buffers(b.column(0))
            label = np.asarray(b.column(1).to_pylist(), object)
            most: dict[str, float] = {}
            for i, j in slices(offsets, SLICE):
                e, n = model.value.entropies(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                best, _, low, _ = model.value.decide(e, n)
                over = model.value.excess(best, low, n)
                for r in np.flatnonzero((langs[best] == label[i:j]) & (n > 0) & (over > 0)).tolist():
                    most[label[i + r]] = max(most.get(label[i + r], 0.0), float(over[r]))
            yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.string()), pa.array(list(most.values()), pa.float64())], ["lang", "excess"])

    return run


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, margin: float = 1.5) -> Models | None:
    """Models learned from docs(id, text, lang); None where there is nothing to learn from."""
    sample, langs = _sample(docs, docs_per_lang)
    names = [f"s{i}" for i in range(ORDER)]
    schema = ", ".join(["lang string", *(f"{c} bigint" for c in names), "n bigint"])
    text = sample.where(F.col("text").isNotNull())
    counts = map_arrow(text.where(~F.col("held")).select("text", "lang"), _count_grams, schema).groupBy("lang", *names).agg(F.sum("n").alias("n")).toPandas()
    langs = [x for x in langs if (counts["lang"] == x).any()]
    if not langs:
        return None
    model = train(counts, langs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    apart = map_arrow(text.where("held").select("text", "lang"), _entropies(shared), "lang string, e array<double>, n bigint").where("n > 0").toPandas()
    shared.unpersist()
    apart = apart[apart["lang"].isin(langs)]
    if len(apart):
        e, n, y = np.stack(apart["e"].to_numpy()), apart["n"].to_numpy(), apart["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
        own = e[np.arange(len(y)), y]
        loss = []
        grid = 2.0 ** np.arange(-12, 1)
        for t in grid:
            z = -(e - e.min(1, keepdims=True)) * (np.log(2) * t * n[:, None])
            loss.append(float((np.log(np.exp(np.maximum(z, -700)).sum(1)) - z[np.arange(len(y)), y]).mean()))
        model.temperature = float(grid[int(np.argmin(loss))])
        model.limits = np.array([own[y == i].max() + margin if (y == i).any() else own.max() + margin for i in range(len(langs))])
        shared = docs.sparkSession.sparkContext.broadcast(model)
        rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
        most = {r["lang"]: r["excess"] for r in map_arrow(rows, _most_excess(shared), "lang string, excess double").groupBy("lang").agg(F.max("excess").alias("excess")).collect()}
        shared.unpersist()
        model.allowed = np.array([max(SIGNIFICANT, most.get(x, 0.0) + ROUNDING) for x in langs])
    return model


def identify(docs: DataFrame, model: Models | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score, bits_per_char, rejected for every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select(F.col("id").alias(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_char"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        forget()
        langs = np.asarray([*shared.value.langs, UNKNOWN], object)
        for b in batches:
            raw, offsets = text_buffers(b.column(1))
            for i, j in slices(offsets, SLICE):
                e, n = shared.value.entropies(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                best, score, low, rejected = shared.value.decide(e, n)
                none = n <= 0
                best = np.where(none, len(langs) - 1, best)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(langs[best], pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(low, mask=none), pa.array(rejected)], ["id", "lang_pred", "score", "bits_per_char", "rejected"])

    return map_arrow(rows, run, f"id {kind}, lang_pred string, score double, bits_per_char double, rejected boolean").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Models | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are not rejected; none where nothing was learned."""
    if model is None:
        return docs.limit(0)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        forget()
        for b in batches:
            raw, offsets = text_buffers(b.column(at))
            for i, j in slices(offsets, SLICE):
                rejected = shared.value.decide(*shared.value.entropies(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))[3]
                yield b.slice(i, j - i).filter(pa.array(~rejected))

    return map_arrow(docs, run, docs.schema)
