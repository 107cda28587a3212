"""Extractive summaries: TextRank per document, the lead as a baseline, and TF-IDF sentence vectors."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, stem, text_of
from ..functions.vectors import _stem

DAMPING, ROUNDS, SETTLED, LINK = 0.85, 40, 1e-6, 0.05
LEAST_CHARS, MOST_CHARS = 25, 600
MEETINGS = 1 << 20  # of sentences held at once, besides one sentence's
RE_SPLIT = r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])|\n{2,}"


def split_sentences(text: str) -> list[str]:
    """Sentences; those over MOST_CHARS are cut at a full stop in their later half, else at a blank."""
    out, todo = [], [p.strip() for p in re.split(RE_SPLIT, text or "")]
    for piece in todo:
        while len(piece) > MOST_CHARS:
            head = piece[:MOST_CHARS]
            stop = head.rfind(". ")
            stop = stop if stop >= MOST_CHARS // 2 else head.rfind(" ")
            if stop <= 0:
                break
            out.append(head[:stop].strip())
            piece = piece[stop:].lstrip(". ").strip()
        out.append(piece)
    return [p for p in out if p]


def _terms(sentence: str) -> Counter:
    words = (w.strip(".'-") for w in re.findall(r"[A-Za-z0-9_@'.+-]+", sentence.lower()))
    return Counter(_stem(w) for w in words if len(w) >= 2 and w not in STOPWORDS and not w.isdigit())


def sentence_links(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """from, to, weight of the sentences whose TF-IDF cosine exceeds LINK. Sentences meet through the postings of
    their terms, some sentences at a time, so that memory goes with terms and links, not with sentences squared."""
    n, name = len(parts), {}
    rows = [(i, name.setdefault(t, len(name)), c) for i, p in enumerate(parts) for t, c in _terms(p).items()]
    at, term, count = np.array(rows, np.int64).reshape(-1, 3).T
    df = np.bincount(term, minlength=1)
    w = (1 + np.log(count)) * (np.log((n + 1) / (df[term] + 1)) + 1)
    w /= np.sqrt(np.bincount(at, w * w, n))[at]
    shared = df[term] > 1
    at, term, w = at[shared], term[shared], w[shared]
    order = np.argsort(term, kind="stable")
    held, weight, first = at[order], w[order], np.cumsum(df * (df > 1)) - df * (df > 1)
    meets = df[term]
    part = np.cumsum(np.bincount(at, meets, n) + n) // MEETINGS  # of each sentence
    ends = [*(np.flatnonzero(np.diff(part)) + 1), n]
    found = []
    for lo, hi in zip([0, *ends], ends):
        a, b = np.searchsorted(at, [lo, hi])
        own = np.repeat(np.arange(a, b), meets[a:b])
        place = first[term[own]] + np.arange(len(own)) - np.repeat(np.cumsum(meets[a:b]) - meets[a:b], meets[a:b])
        cosine = np.bincount((at[own] - lo) * n + held[place], w[own] * weight[place], (hi - lo) * n).reshape(hi - lo, n)
        cosine[np.arange(hi - lo), np.arange(lo, hi)] = 0
        i, j = np.nonzero(cosine > LINK)
        found.append((i + lo, j, cosine[i, j]))
    src, dst, cosines = (np.concatenate(x) for x in zip(*found))
    return src, dst, cosines


def rank_sentences(parts: list[str]) -> np.ndarray:
    """PageRank over the graph of linked sentences; scores relative to the best, later ones damped."""
    n = len(parts)
    src, dst, weight = sentence_links(parts)
    total = np.bincount(src, weight, n)
    step = weight / total[src]
    alone = total == 0
    score = np.full(n, 1.0 / n)
    for _ in range(ROUNDS):
        new = (1 - DAMPING) / n + DAMPING * (np.bincount(dst, score[src] * step, n) + score[alone].sum() / n)
        moved, score = np.abs(new - score).sum(), new
        if moved < SETTLED:
            break
    return score / score.max() * (1 - 0.05 * np.arange(n) / n)


def textrank(text: str, most: int = 5) -> list[str]:
    parts = [p for p in split_sentences(text) if (len(p) >= LEAST_CHARS or p.endswith("?")) and sum(islice((1 for ch in p if ch.isalpha()), 3)) == 3]
    if not parts:
        return []
    k = max(1, min(most, round(0.6 * math.sqrt(len(parts)))))
    score = rank_sentences(parts)
    best = np.lexsort((np.arange(len(parts)), -score))[:k]
    return [parts[i] for i in sorted(best)]


def summaries(docs: DataFrame, id_col: str, text_col: str, most: int = 5) -> DataFrame:
    """id, summary (sentences in order of the text): one document at a time, as each is its own graph."""

    @F.pandas_udf("array<string>")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(lambda t: textrank(t, most))

    return docs.select(F.col(id_col), udf(text_of(text_col)).alias("summary"))


def sentence_column(c) -> Column:
    return F.filter(F.transform(F.split(text_of(c), RE_SPLIT), lambda x: F.btrim(x)), lambda s: s != "")


def lead(docs: DataFrame, id_col: str, text_col: str, most: int = 5) -> DataFrame:
    return docs.select(F.col(id_col), F.slice(sentence_column(text_col), 1, most).alias("summary"))


def sentence_tfidf(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, sentence, term, weight: L2-normalised TF-IDF vectors of a document's sentences, without Python."""
    s = docs.select(F.col(id_col).alias("id"), F.posexplode(sentence_column(text_col)).alias("sentence", "s"))
    words = F.filter(F.transform(F.regexp_extract_all(F.lower("s"), F.lit(r"[A-Za-z0-9_@'.+-]+"), F.lit(0)), lambda w: F.btrim(w, F.lit(".'-"))), lambda w: (F.length(w) >= 2) & ~w.isin(STOPWORDS) & ~w.rlike("^[0-9]+$"))
    tf = s.select("id", "sentence", F.explode(F.transform(words, stem)).alias("term")).groupBy("id", "sentence", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = s.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("id", "term").agg(F.count(F.lit(1)).alias("df"))
    w = tf.join(df, ["id", "term"]).join(n, "id").withColumn("w", (1 + F.log("tf")) * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1))
    norm = w.groupBy("id", "sentence").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, ["id", "sentence"]).select(F.col("id").alias(id_col), "sentence", "term", (F.col("w") / F.col("norm")).alias("weight"))


def summarizer(mode: str = "extractive"):
    return {"extractive": summaries, "lead": lead}.get(mode, summaries)
