"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors are sparse integer rows: component x of dimension t is a posting of term t with weight
floor(scale * x). Queries and candidates are dealt into blocks; every block of candidates meets every
block of queries. Within a pair of blocks each term scatters query weight times posting weight into a
dense array of scores; a partition selection keeps each query's k best of the block, and the partial
lists of all blocks are merged by query.

Vectors that are null or hold a null or non-finite component take no part. Rows with one id are
different candidates but for the query's own id, which is never returned. Ties go to the smaller id.
Scores that might not fit 64 bits are an error, not a wrong number.
Vectors shorter than others count as zero in what they lack. Ids must not be null; such rows take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, CANDIDATE_BLOCK = 2_048, 8_192


def clean_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec of the rows whose vector is complete and finite."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(~bad)


def grid(rows: DataFrame, is_query, query_block: int, candidate_block: int) -> DataFrame:
    """Rows as (qb, cb, role, id, vec): each pair of blocks holds its queries and its candidates.

    A row's block is a hash of its id; blocks number rows / block size, so that a pair of blocks is of
    bounded size whatever the input's.
    """
    n, nq = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    nc, nq = max(1, math.ceil(n / candidate_block)), max(1, math.ceil(nq / query_block))
    block = lambda seed, k: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(k)).cast("int")
    cand = rows.select(F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), block(1, nc).alias("cb"), F.lit(False).alias("is_query"), "id", "vec")
    query = rows.where(is_query).select(block(2, nq).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("cb"), F.lit(True).alias("is_query"), "id", "vec")
    return cand.unionByName(query)


def select_best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def accumulate(query: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """Scores[q, c] of integer weights, a term at a time over postings lists."""
    most = int(np.abs(query).max(initial=0)) * int(np.abs(cand).max(initial=0)) * query.shape[1]
    if most >= 1 << 63:
        raise OverflowError("components are too large for 64-bit scores")
    kind = np.int32 if most < 1 << 31 else np.int64  # the narrowest that no score overflows
    query, scores, part = query.astype(kind), np.zeros((len(query), len(cand)), kind), np.empty(len(cand), kind)
    terms = []
    for t in range(query.shape[1]):
        posted = np.flatnonzero(cand[:, t])
        terms.append((None if len(posted) == len(cand) else posted, cand[posted, t].astype(kind)))
    for q in range(len(query)):  # a query's scores stay in cache while its terms are scattered
        row = scores[q]
        for t in np.flatnonzero(query[q]).tolist():
            posted, w = terms[t]
            if posted is None:
                np.multiply(w, query[q, t], out=part)
                row += part
            else:
                row[posted] += query[q, t] * w
    return scores


def joined(**columns: list[np.ndarray]) -> pd.DataFrame:
    """One table of the arrays of each column; empty ones are integers."""
    return pd.DataFrame({k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in columns.items()})


def dense(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def topk(table: DataFrame, is_query, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank (from 1), id_col, score for the rows where is_query (a column over ``id``) holds."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf["is_query"].to_numpy(bool)
        q, c = pdf[asked], pdf[~asked]
        width = int(pdf["vec"].map(len).max())

        def weights(part):
            out = np.floor(scale * dense(part["vec"], width))
            if (np.abs(out) >= 2.0**62).any():
                raise OverflowError("components are too large for 64-bit scores")
            return out.astype(np.int64)

        qid, cid, qw, cw = q["id"].to_numpy(np.int64), c["id"].to_numpy(np.int64), weights(q), weights(c)
        own, ids, best_scores = [], [], []
        order = np.argsort(cid, kind="stable")
        for at in range(0, len(qid), 64):  # bounds the score array
            scores = accumulate(qw[at : at + 64], cw)
            for i, row in enumerate(scores):
                lo = int(np.searchsorted(cid, qid[at + i], sorter=order))
                hi = int(np.searchsorted(cid, qid[at + i], "right", sorter=order))
                if hi > lo:  # the query's own rows
                    keep = np.delete(np.arange(len(cid)), order[lo:hi])
                    best = keep[select_best(row[keep], cid[keep], k)]
                else:
                    best = select_best(row, cid, k)
                own.append(np.full(len(best), qid[at + i]))
                ids.append(cid[best])
                best_scores.append(row[best].astype(np.int64))
        return joined(query_id=own, id=ids, score=best_scores)

    rows = clean_vectors(table, id_col, vec_col)
    parts = grid(rows, is_query, query_block, candidate_block)
    found = parts.groupBy("qb", "cb").applyInPandas(block, "query_id bigint, id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
