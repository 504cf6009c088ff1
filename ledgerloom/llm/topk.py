"""Operator 2, exact top-k search: exhaustive term-at-a-time accumulation.

A vector is a sparse row of integer weights, its terms the component numbers. Queries and candidates are dealt into
blocks; each pair of blocks meets in one task. There, every query row scatters its weighted postings, term after term,
into a dense array of the block's scores, partition selection keeps the k best, and a last merge goes by query row.

A vector that is null or holds a null or non-finite component takes no part, nor does a row without id. Of unequal
lengths, the missing components count as 0. A query skips every row of its own id. Repeated candidates count each;
repeated query rows are answered each. Fewer than k candidates give fewer rows; an empty table gives none. Only the id and the
vector are read of the columns. Weights and scores are 64-bit: components whose products leave that range are not supported.

Each row goes to every block of the other side, so a pair of blocks of b rows moves 2 b rows for b * b * width
multiplications: at 16384 rows, some 10 MB for 10 to 20 seconds of one core. Blocks are smaller only where there would be
too few for the cores.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def quantise(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x as double, null where the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores by (score descending, id ascending); ids ascend."""
    if len(scores) <= k:
        kept = np.arange(len(scores))
    else:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        over = np.flatnonzero(scores > least)
        kept = np.concatenate([over, np.flatnonzero(scores == least)[: k - len(over)]])
    return kept[np.lexsort((ids[kept], -scores[kept]))]


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", query_block: int = 16384, row_block: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k best rows by inner product of the quantised vectors."""
    q, c = (df.select(F.col(key).cast("long").alias("id"), quantise(F.col(vector)).alias("w")).where("id is not null and w is not null") for df in (queries, rows))
    n_q, n_c = q.count(), c.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    qbs, cbs = max(1, math.ceil(n_q / query_block)), max(1, math.ceil(n_c / row_block), min(4 * cores, math.ceil(n_c / 1024)))
    number = F.monotonically_increasing_id()
    # Both sides' blocks are of one type: a cogroup does not cast its keys, and an int and a long go to different partitions.
    of, each = lambda c, n: F.pmod(c, F.lit(n)).cast("long"), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = q.withColumn("row", number).withColumn("qb", of("row", qbs)).withColumn("cb", each(cbs))
    c = c.withColumn("cb", of(number, cbs)).withColumn("qb", each(qbs))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({x: np.empty(0, np.int64) for x in ("row", "query_id", "vec_id", "score")})
        if not len(a) or not len(b):
            return empty
        b = b.sort_values("id", kind="stable")
        width = max(a["w"].map(len).max(), b["w"].map(len).max())
        ids, weights, asked = b["id"].to_numpy(), _matrix(b["w"], width), _matrix(a["w"], width)
        postings = [(at, weights[at, t]) for t in range(width) for at in [np.flatnonzero(weights[:, t])]]
        out = []
        for row, own, terms in zip(a["row"], a["id"], asked):
            scores = np.zeros(len(ids), np.int64)
            for t in np.flatnonzero(terms):
                at, w = postings[t]
                if len(at) == len(scores):
                    scores += terms[t] * w
                else:
                    scores[at] += terms[t] * w
            others = np.flatnonzero(ids != own)
            at = others[best(scores[others], ids[others], k)]
            out.append(pd.DataFrame({"row": row, "query_id": own, "vec_id": ids[at], "score": scores[at]}))
        return pd.concat(out) if out else empty

    met = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(meet, "row long, query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
