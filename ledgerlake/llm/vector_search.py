"""Nearest neighbours by a block matrix join on int8 products with error bounds.

Queries and candidates are dealt into blocks; a tile is one block of queries with
one block of candidates. Each vector is also kept as int8 codes with a scale of its
own, v = s * c + e, with the length of e known. So a product of codes (an int8
product tile, computed as one matrix product) gives each distance up to a bound:

    | |q - v| - |q' - v'| | <= |e_q| + |e_v|     (q', v': decoded vectors)

Pairs whose lower bound lies above the k-th smallest upper bound of their query
cannot be among its k nearest. The others (the survivors) are computed again in
double precision from the original vectors, and the k nearest of each query go on.
Heaps merge them within a tile, and Spark's ranking over all tiles of a query. The
result is exact; the bounds only save work.

Spark deals the tiles out: candidates are not repeated while one block of queries
holds all of them, and else once for each block of QUERY_BLOCK queries; queries are
repeated once for each block of candidates. No tile grows with the data. The work is
queries times candidates: where a fixed share of all rows are queries, it grows with
the square of the table, as an exact search must.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, ROW_BLOCK = 4_096, 8_192

_VECTORS = "tile string, id long, vec array<double>"
_HITS = "query_id long, id long, score double"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each row, and an upper bound of the length of what the codes miss."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = np.finfo(float).tiny
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    error = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error * (1 + 1e-9) + 1e-12 * scale * 127


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows. Floats multiply fastest; a sum stays exact while it fits their fraction."""
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def exact_distance(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, each summed in order of the components."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += (q[:, j] - v[:, j]) ** 2
    return np.sqrt(total)


def search_tile(q_ids, q, v_ids, v, k: int) -> list[tuple[int, int, float]]:
    """(query, row, distance): the k nearest rows of each query within the tile, itself left out."""
    (qc, qs, qe), (vc, vs, ve) = quantise(q), quantise(v)
    q_len = (qc.astype(np.float64) ** 2).sum(axis=1) * qs**2
    v_len = (vc.astype(np.float64) ** 2).sum(axis=1) * vs**2
    out = []
    step = max(1, (1 << 22) // max(1, len(v)))  # 32 MB of doubles at once
    for a in range(0, len(q), step):
        b = min(len(q), a + step)
        square = q_len[a:b, None] + v_len[None, :] - 2 * int8_product(qc[a:b], vc) * (qs[a:b, None] * vs[None, :])
        slack = 1e-9 * (q_len[a:b, None] + v_len[None, :])
        low = np.sqrt(np.maximum(square - slack, 0)) - qe[a:b, None] - ve[None, :]
        high = np.sqrt(np.maximum(square + slack, 0)) + qe[a:b, None] + ve[None, :]
        own = q_ids[a:b, None] == v_ids[None, :]
        high[own] = np.inf
        low[own] = np.inf
        limit = np.partition(high, min(k, high.shape[1]) - 1, axis=1)[:, min(k, high.shape[1]) - 1]
        rows, cols = np.nonzero((low <= limit[:, None] * (1 + 1e-9)) & ~own)
        distance = exact_distance(q[a + rows], v[cols])
        starts = np.searchsorted(rows, np.arange(b - a + 1))
        for i in range(b - a):
            span = slice(starts[i], starts[i + 1])
            found = zip(distance[span].tolist(), v_ids[cols[span]].tolist())
            out += [(int(q_ids[a + i]), n, d) for d, n in heapq.nsmallest(k, found)]
    return out


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec, dim): rows with an id whose vector is no null, not empty, not all zero and finite throughout."""
    vec = F.col(vector_col).cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    some = F.exists(vec, lambda x: x != 0)
    rows = df.where(F.col(id_col).isNotNull() & vec.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(some, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), F.size(vec).alias("dim"))


def nearest(
    queries: DataFrame,
    rows: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_block: int = QUERY_BLOCK,
    row_block: int = ROW_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query by Euclidean distance.

    Ranks count from 1, nearest first, ties to the smaller id. A row is no
    neighbour of a query with its id. Vectors that are null, empty, all zero or
    hold null or non-finite components take no part, and a query meets only rows
    of its own number of components. Rows count as often as they are given, equal ones
    too, and come one after another; equal queries count once. Other columns are
    dropped, whatever their names. Without usable rows the result is empty.
    """
    q = usable(queries, id_col, vector_col).dropDuplicates(["id", "vec"])
    v = usable(rows, id_col, vector_col)
    # Two counts decide how many blocks there are; nothing else is gathered.
    n_q, n_v = q.count(), v.count()
    q_blocks, v_blocks = max(1, math.ceil(n_q / query_block)), max(1, math.ceil(n_v / row_block))

    def tiles(df, own, others, other_first: bool):
        block = F.pmod(F.xxhash64("id"), F.lit(own))
        pair = [F.col("other"), block] if other_first else [block, F.col("other")]
        spread = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return spread.select(F.concat_ws("/", "dim", *pair).alias("tile"), "id", "vec")

    q_tiles, v_tiles = tiles(q, q_blocks, v_blocks, False), tiles(v, v_blocks, q_blocks, True)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": float})
        found = search_tile(
            left["id"].to_numpy(), np.array(left["vec"].tolist(), dtype=float),
            right["id"].to_numpy(), np.array(right["vec"].tolist(), dtype=float), k,
        )
        return pd.DataFrame(found, columns=["query_id", "id", "score"])

    hits = q_tiles.groupBy("tile").cogroup(v_tiles.groupBy("tile")).applyInPandas(run, _HITS)
    # Spark keeps the k best of each query before and after the shuffle, so no task gathers a query's hits.
    nearest_first = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = hits.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op9_vector_search(spark, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every vector whose id is divisible by 100."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows.where("vec_id % 100 = 0"), rows)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, 
    sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
  FROM (SELECT DISTINCT * FROM v) q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS k FROM d
)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(k AS INTEGER) AS rank, CAST(vec_id AS BIGINT) AS vec_id, score
FROM r WHERE k <= 10
"""
