"""Ranked lexical search by dense blocked matrix products.

Items (the queries) are dealt into tiles of ITEM_TILE; a tile's vocabulary is compact:
the terms of its items only, numbered. A document's impacts on these terms are whole
numbers, and so are the weights of the items' terms. So a tile of items times a tile of
documents is a product of two dense matrices in float64, block of vocabulary by block,
which BLAS does at full speed; a block ends where the sum of an item's products could
reach 2^53, so every partial sum is exact, and blocks are added as 64-bit integers.

A term's weight depends on how many documents hold it, and an impact on the length of
all documents. So texts are cut into terms once, in a first pass that writes each
document's length and its counts of item terms; the statistics are sums over that table.

From each tile of documents go the k best of each item and all that tie with the last of
them, as long as they could still be among the task's k best: a heap that many equal
scores cannot mislead. Tasks' lists are merged in two rankings, first among some tasks.

Items are worked on in groups of bounded size (their terms, or one item, if that is
larger), one pass each; only a group's terms are broadcast. Documents are not shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import Scratch, release, slices

TOP_K = 20
#: Items and documents of a tile, and terms of a block of its vocabulary: 8 MB and 32 MB of doubles.
ITEM_TILE, DOC_TILE, TERM_BLOCK = 256, 1_024, 4_096
#: Bytes of the terms (with 24 more each) of the items of one group.
GROUP_BYTES = 16 << 20
#: Impacts are under IMPACT; a term that an item repeats more often than REPEATS is taken in several layers.
IMPACT, REPEATS, EXACT = 1_000_000, 100_000, 1 << 53
#: A longer text is cut into terms piece by piece.
PIECE = 4 << 20
#: Tasks whose lists meet in the first ranking.
MERGED = 256

#: A-Z in lower case, ASCII letters, digits and all bytes over 127 as they are, the rest as spaces.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: str | None):
    """The terms of a text in lists: runs of letters and digits of ASCII and of all other characters, A-Z in lower case."""
    data, at = (text or "").encode().translate(_TERM_BYTES), 0
    while at < len(data):
        cut = data.find(b" ", at + PIECE) if len(data) - at > 2 * PIECE else -1
        end = len(data) if cut < 0 else cut
        yield data[at:end].split()
        at = end


class Group:
    """The items of one group: numbered terms, and the items' counts of them in tiles."""

    def __init__(self, rows: list):
        self.item_ids = np.array([r["item"] for r in rows], dtype=np.int64)
        self.terms = sorted({bytes(t) for r in rows for t in r["terms"]})
        self.number = {t: i for i, t in enumerate(self.terms)}
        counts = [dict(zip((self.number[bytes(t)] for t in r["terms"]), r["counts"])) for r in rows]
        #: (first item, items, terms, item of each entry, place in the terms, count)
        self.tiles = []
        for first in range(0, len(rows), ITEM_TILE):
            some = counts[first : first + ITEM_TILE]
            codes = np.concatenate([np.array(list(c), dtype=np.int64) for c in some])
            of = np.repeat(np.arange(len(some)), [len(c) for c in some])
            vocabulary, place = np.unique(codes, return_inverse=True)
            self.tiles.append((first, len(some), vocabulary, of, place, np.concatenate([np.array(list(c.values()), dtype=np.int64) for c in some])))


def blocks(sums: np.ndarray, most: int = TERM_BLOCK, limit: int = EXACT) -> list[tuple[int, int]]:
    """Cuts of a vocabulary so that no row's sum of ``sums`` (bounds of products) within a block reaches the limit.

    A single column is below the limit by itself.
    """
    out, first = [], 0
    n = sums.shape[1]
    while first < n:
        end = min(n, first + most)
        over = np.flatnonzero((np.cumsum(sums[:, first:end], axis=1) >= limit).any(axis=0))
        if len(over):
            end = first + max(1, int(over[0]))
        out.append((first, end))
        first = end
    return out


def layers(counts: np.ndarray) -> list[np.ndarray]:
    """Counts as a sum of arrays with at most REPEATS in each place."""
    return [np.clip(counts - k * REPEATS, 0, REPEATS) for k in range(-(-int(counts.max()) // REPEATS))]


class Best:
    """The k best (score, document) of each item so far, equal scores by ascending document."""

    def __init__(self, n: int, k: int):
        self.k, self.limit = k, np.ones(n, dtype=np.int64)
        self.item, self.score, self.doc = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, first: int, scores: np.ndarray, docs: np.ndarray) -> None:
        """Scores of a tile, items by documents."""
        limit, n = self.limit[first : first + len(scores)], scores.shape[1]
        if n > self.k:  # ties with the k-th stay
            limit = np.maximum(limit, np.partition(scores, n - self.k, axis=1)[:, n - self.k])
        item, at = np.nonzero(scores >= limit[:, None])
        if len(item):
            self.merge(item + first, scores[item, at], docs[at])

    def merge(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = np.concatenate([self.item, item]), np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.k
        last = rank == self.k - 1
        self.limit[item[last]] = score[last]
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]


def tile_scores(tile: tuple, weights: np.ndarray, codes: np.ndarray, impacts: np.ndarray, doc: np.ndarray, n_docs: int, most: int = TERM_BLOCK, limit: int = EXACT) -> np.ndarray:
    """Exact scores of a tile's items (rows) for the documents of a tile (columns), as 64-bit integers."""
    _, n_items, vocabulary, of, place, counts = tile
    # The documents' entries that lie in the tile's vocabulary.
    at = np.searchsorted(vocabulary, codes)
    at[at == len(vocabulary)] = 0
    own = vocabulary[at] == codes
    at, doc, impacts = at[own], doc[own], impacts[own]
    order = np.argsort(at, kind="stable")
    at, doc, impacts = at[order], doc[order], impacts[order]
    total = np.zeros((n_items, n_docs), dtype=np.int64)
    for layer in layers(counts):
        left = np.zeros((n_items, len(vocabulary)))
        left[of, place] = layer * weights[vocabulary[place]]
        for a, b in blocks(left * IMPACT, most, limit):
            x, y = np.searchsorted(at, (a, b))
            if x < y:
                right = np.zeros((b - a, n_docs))
                right[at[x:y] - a, doc[x:y]] = impacts[x:y]
                total += (left[:, a:b] @ right).astype(np.int64)
    return total


def _group(items: DataFrame, number: int) -> Group | None:
    rows = items.where(F.col("group") == number).select("item", "terms", "counts").orderBy("item").collect()  # GROUP_BYTES at most, or one item
    return Group(rows) if rows else None


def _items(items: DataFrame, item_col: str, text_col: str, scratch: Scratch, group_bytes: int) -> tuple[DataFrame, int]:
    """(group, item, terms, counts) of all items, and the number of groups."""
    texts = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()

    def cut(batches):
        for batch in (part for whole in batches for part in slices(whole, 1)):
            ids, names, counts = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found: dict[bytes, int] = {}
                for some in terms(text):
                    for t in some:
                        found[t] = found.get(t, 0) + 1
                if found:
                    ids.append(item)
                    names.append(list(found))
                    counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int64()))], names=["item", "terms", "counts"])

    each = texts.mapInArrow(cut, "item long, terms array<binary>, counts array<long>")
    # Texts that share an item's id are one item: their terms together.
    some = each.groupBy("item").agg(F.count(F.lit(1)).alias("texts"), F.flatten(F.collect_list("terms")).alias("terms"), F.flatten(F.collect_list("counts")).alias("counts"))
    zipped = F.arrays_zip("terms", "counts")
    summed = F.transform(F.array_distinct("terms"), lambda t: F.aggregate(F.filter(zipped, lambda z: z["terms"] == t), F.lit(0).cast("long"), lambda a, z: a + z["counts"]))
    some = some.select("item", F.when(F.col("texts") > 1, summed).otherwise(F.col("counts")).alias("counts"), F.array_distinct("terms").alias("terms"))
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 24)
    table = scratch.table(some.select("item", "terms", "counts", size.alias("bytes")), "items")
    # The number of groups is raised until each is small enough or holds one item.
    n = max(1, math.ceil((table.agg(F.sum("bytes")).first()[0] or 0) / group_bytes))
    while True:
        grouped = table.withColumn("group", F.pmod(F.xxhash64("item"), F.lit(n)).cast("int"))
        sizes = grouped.groupBy("group").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        if n == 1 or not sizes.where((F.col("b") > 2 * group_bytes) & (F.col("n") > 1)).limit(1).count():
            return grouped, n
        n *= 2


def search(
    docs: DataFrame, items: DataFrame, k: int = TOP_K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """(item, rank, id, score): the k documents with the highest score above 0 for each item, ties by ascending id.

    A term's weight is floor(1000 ln((2N+2) / (2df+1))), N the documents with a term and df
    those with this one; a document of n terms (of L in all) gives weight * (10^9 tf div
    (1000 tf + 12 m)) for each occurrence of the term in the item, m = 75 + (25 n N div L).
    Null texts have no terms. Every row of docs is a document: equal rows count, and rank,
    one after the other; rows without an id count in N, L and df but are not ranked. Items
    without an id or terms give no rows; equal items count once, and texts that share an
    item's id are one item. Other columns are dropped, whatever their names. Empty tables
    give an empty result. A very long text takes about 100 bytes of a worker's memory for
    each of its terms within 8 MB of it.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "ranked")
    asked, n_groups = _items(items, item_col, item_text, scratch, group_bytes)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    lists = []
    for number in range(n_groups):
        group = _group(asked, number)
        if group is not None:
            lists.append(_best_of_group(texts, spark.sparkContext.broadcast(group), len(group.terms), k, scratch, number))
    if not lists:
        empty = spark.createDataFrame([], "item long, rank int, doc long, score long")
        return empty.toDF(item_col, "rank", id_col, "score")
    best = lists[0]
    for other in lists[1:]:
        best = best.unionByName(other)

    def ranked(df: DataFrame, *keys: str) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy("item", *keys).orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k)

    merged = ranked(ranked(best, "some"))
    return merged.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score")


def _best_of_group(texts: DataFrame, shared, n_terms: int, k: int, scratch: Scratch, number: int) -> DataFrame:
    """(item, some, doc, score): what each task has found for the items of a group; ``some`` numbers sets of tasks."""

    def count(batches):
        find = shared.value.number.get
        for batch in (part for whole in batches for part in slices(whole, 1)):
            sizes, codes, counts, ends = [], [], [], [0]
            for text in batch.column(1).to_pylist():
                n, found = 0, []
                for some in terms(text):
                    n += len(some)
                    found += [c for c in map(find, some) if c is not None]
                code, tf = np.unique(np.array(found, dtype=np.int32), return_counts=True)
                sizes.append(n)
                codes.append(code)
                counts.append(tf)
                ends.append(ends[-1] + len(code))
            offsets = pa.array(ends, pa.int32())
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int32))) for x in (codes, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *arrays], names=["doc", "n", "codes", "tf"])
        release()

    counted = scratch.table(texts.mapInArrow(count, "doc long, n long, codes array<int>, tf array<int>"), f"counted-{number}")

    def holders(batches):
        held = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["code", "df"])

    n_docs, length = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = counted.select("codes").mapInArrow(holders, "code long, df long").groupBy("code").agg(F.sum("df").alias("df"))
    weights = np.zeros(n_terms, dtype=np.int64)
    for code, df in held.collect():  # one row for each term of the group
        weights[code] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    weights = texts.sparkSession.sparkContext.broadcast(weights)

    def score(batches):
        group, w = shared.value, weights.value
        best = Best(len(group.item_ids), k)
        part = 0
        for batch in batches:
            part = batch.column(4)[0].as_py()
            for start in range(0, batch.num_rows, DOC_TILE):
                tile = batch.slice(start, DOC_TILE)
                lists = tile.column(2)
                sizes = np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(tile.num_rows), sizes)
                codes, tf = lists.flatten().to_numpy(), tile.column(3).flatten().to_numpy().astype(np.int64)
                m = 75 + 25 * tile.column(1).to_numpy() * n_docs // length
                impacts = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
                ids = tile.column(0).to_numpy()
                for items in group.tiles:
                    best.add(items[0], tile_scores(items, w, codes, impacts, doc, tile.num_rows), ids)
        columns = group.item_ids[best.item], np.full(len(best.item), part // MERGED), best.doc, best.score
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "some", "doc", "score"])
        release()

    some = counted.where(F.col("doc").isNotNull() & (F.size("codes") > 0)).select("doc", "n", "codes", "tf", F.spark_partition_id().alias("part"))
    return some.mapInArrow(score, "item long, some long, doc long, score long")


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The twenty highest-scoring documents of each benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)
), q AS (SELECT item_id, term, count(*) AS qtf FROM i GROUP BY ALL),
s AS (SELECT CAST(count(*) FILTER (len(terms) > 0) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS length FROM d),
t AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term, n_docs),
x AS (
  SELECT item_id, doc_id, row, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // length)))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN w USING (term), s WHERE doc_id IS NOT NULL GROUP BY item_id, doc_id, row
), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(rank AS INTEGER) AS rank, CAST(doc_id AS BIGINT) AS doc_id, score FROM r WHERE rank <= 20
"""
