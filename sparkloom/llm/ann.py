"""Approximate nearest neighbours by randomly rotated one-bit codes.

Each vector's residual from the centre is normalised and rotated by a seeded random orthogonal
matrix; its code is the sign of each coordinate, packed to bits, with two correction scalars: the
residual's norm and the inner product of the code's unit vector with the rotated residual. A query is
rotated alike; the inner product with each code, divided by the correction, estimates that with the
vector without bias, and its error stays within ``eps`` standard bounds but with small probability.

Every block of candidates is scanned by codes alone. The k-th smallest upper bound of the squared
distance in a block decides which vectors' lower bounds could still be among the k nearest; those are
reranked by exact distance in double precision, and the blocks' lists merged by query.

Only the centre is fitted, as the mean of all rows. Vectors that are null, zero or hold null or
non-finite components take no part; nor do rows with a null id. Ties go to the smaller id.
Vectors shorter than the longest count as zero in what they lack.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .topk import clean_vectors, dense, grid, joined


@functools.cache
def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, residual norms, inner products of code and unit residual)."""
    residual = (vectors - centre) @ turn
    norm = np.sqrt((residual**2).sum(1))
    dim = vectors.shape[1]
    with np.errstate(invalid="ignore", divide="ignore"):
        fit = np.where(norm > 0, np.abs(residual).sum(1) / (norm * np.sqrt(dim)), 1.0)
    return np.packbits(residual > 0, axis=1), norm, fit


def distance_bounds(query: np.ndarray, codes: np.ndarray, norm: np.ndarray, fit: np.ndarray, centre: np.ndarray, turn: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distance from one query to all coded vectors."""
    dim = len(query)
    residual = (query - centre) @ turn
    length = np.sqrt((residual**2).sum())
    unit = residual / length if length > 0 else residual
    # a table of each byte's signed sum turns the packed bits into inner products
    pad = np.zeros(codes.shape[1] * 8)
    pad[:dim] = unit
    signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1.0
    table = pad.reshape(-1, 8) @ signs.T
    inner = table[np.arange(codes.shape[1])[:, None], codes.T].sum(0) / np.sqrt(dim)
    estimate = inner / fit
    error = eps * np.sqrt(np.maximum(0.0, 1.0 - fit**2)) / fit / np.sqrt(max(1, dim - 1))
    base, scale = norm**2 + length**2, 2 * norm * length
    return base - scale * np.minimum(1.0, estimate + error), base - scale * np.maximum(-1.0, estimate - error)


def nearest(table: DataFrame, is_query, k: int = 10, eps: float = 3.0, seed: int = 23, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = 2_048, candidate_block: int = 8_192) -> DataFrame:
    """query_id, rank (from 1), id_col, score (Euclidean distance) for the rows where is_query (over ``id``) holds."""
    rows = clean_vectors(table, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    mean = rows.select(F.posexplode("vec")).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()  # a row per dimension
    centre_all = np.array([r["m"] for r in mean])

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf["is_query"].to_numpy(bool)
        q, c = pdf[asked], pdf[~asked]
        dim = len(centre_all)
        qv, cv = dense(q["vec"], dim), dense(c["vec"], dim)
        qid, cid = q["id"].to_numpy(np.int64), c["id"].to_numpy(np.int64)
        turn = rotation(dim, seed)
        codes, norm, fit = encode(cv, centre_all, turn)
        own, ids, scores = [], [], []
        for i in range(len(qid)):
            low, high = distance_bounds(qv[i], codes, norm, fit, centre_all, turn, eps)
            other = cid != qid[i]
            n = int(other.sum())
            if n == 0:
                continue
            line = np.partition(high[other], min(k, n) - 1)[min(k, n) - 1]
            at = np.flatnonzero(other & (low <= line + 1e-9 * abs(line)))
            exact = np.sqrt(((cv[at] - qv[i]) ** 2).sum(1))
            best = np.lexsort((cid[at], exact))[:k]
            own.append(np.full(len(best), qid[i]))
            ids.append(cid[at][best])
            scores.append(exact[best])
        return joined(query_id=own, id=ids, score=scores)

    found = grid(rows, is_query, query_block, candidate_block).groupBy("qb", "cb").applyInPandas(block, "query_id bigint, id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
