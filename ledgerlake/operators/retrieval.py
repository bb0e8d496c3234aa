"""Batch retrieval: a table of queries against the clauses of their policies.

Nothing runs query by query: lexical and dense scores come from joins on (policy, term)
or policy, and the best k of each query from a ranking that Spark limits before the
shuffle as well.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ledgerlake.plans.scratch import folder, stored

K1, B, RRF = 1.2, 0.75, 60
#: Rows (ids, terms and their weights) up to which a side is broadcast, after they were counted.
FEW = 500_000


def tokens(text: Column) -> Column:
    """Words of a to z and digits, in lower case."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Cut after . ; or : before white space."""
    return F.filter(F.split(F.regexp_replace(text, r"([.;:])[ \t\n\r]+", "$1\u0001"), "\u0001"), lambda s: s != "")


def sentence_windows(text: Column, target: int = 600) -> Column:
    """Sentences packed up to ``target`` characters; a full window hands its last sentence on to the next one."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("open"), F.lit(0).alias("size"), none.alias("out"))

    def add(state: Column, s: Column) -> Column:
        full = (F.size(state["open"]) > 0) & (state["size"] + F.length(s) > target)
        last = F.element_at(state["open"], -1)
        return F.when(
            full,
            F.struct(
                F.array(last, s).alias("open"), (F.length(last) + F.length(s)).alias("size"),
                F.concat(state["out"], F.array(F.array_join(state["open"], " "))).alias("out"),
            ),
        ).otherwise(F.struct(F.concat(state["open"], F.array(s)).alias("open"), (state["size"] + F.length(s)).alias("size"), state["out"].alias("out")))

    def finish(state: Column) -> Column:
        return F.when(F.size(state["open"]) > 0, F.concat(state["out"], F.array(F.array_join(state["open"], " ")))).otherwise(state["out"])

    return F.aggregate(sentences(text), start, add, finish)


def sub_chunk(clauses: DataFrame, threshold: int = 1500, target: int = 600) -> DataFrame:
    """(policy, clause_id, window, text): short texts whole, longer ones as windows, each under the title where there is one."""
    windows = sentence_windows(F.col("text"), target)
    if "title" in clauses.columns:
        windows = F.transform(windows, lambda w: F.trim(F.concat_ws("\n", F.nullif("title", F.lit("")), w)))
    parts = F.when(F.length("text") <= threshold, F.array("text")).otherwise(windows)
    return clauses.select("policy", "clause_id", F.posexplode(parts).alias("window", "text"))


def top_k(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "clause_id") -> DataFrame:
    """The k best rows of each query with their rank, ties to the smaller id."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def near(df: DataFrame) -> DataFrame:
    """A stored side of a join on ids, broadcast where it has up to FEW rows; they are counted."""
    return F.broadcast(df) if df.count() <= FEW else df.hint("merge")


#: What is no letter or digit in a lower-cased text becomes a space; bytes of other scripts are none of these letters.
_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _asked_words(clauses: DataFrame, asked: DataFrame) -> DataFrame:
    """(policy, clause_id, dl, terms): the number of words of each clause, null without a text, and (term, tf) of those that are asked for in its policy.

    ``asked`` (policy, term) has FEW rows at most and goes to all tasks. A text is cut into
    words once and its row stays where it lies.
    """
    wanted: dict = {}
    for row in asked.where("policy IS NOT NULL").collect():
        wanted.setdefault(row["policy"], set()).add(row["term"].encode())
    shared, none = clauses.sparkSession.sparkContext.broadcast(wanted), frozenset()
    counts = StructType.fromDDL("dl int, terms array<struct<term:string,tf:bigint>>")
    schema = StructType([*(StructField(c, clauses.schema[c].dataType) for c in ("policy", "clause_id")), *counts])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ends, terms, tfs = [], [0], [], []
            for policy, text in zip(batch["policy"], batch["lowered"]):
                words = text.as_py().translate(_WORD_BYTES).split() if text.is_valid else []
                told = Counter(filter(shared.value.get(policy.as_py(), none).__contains__, words))
                terms.extend(told.keys())
                tfs.extend(told.values())
                lengths.append(len(words) if text.is_valid else None)
                ends.append(len(terms))
            pairs = arrow.field("terms").type
            each = pa.StructArray.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64())], fields=list(pairs.value_type))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each, type=pairs)
            yield pa.RecordBatch.from_arrays([batch["policy"], batch["clause_id"], pa.array(lengths, pa.int32()), lists], schema=arrow)

    return clauses.select("policy", "clause_id", F.lower("text").cast("binary").alias("lowered")).mapInArrow(run, schema)


def bm25(queries: DataFrame, clauses: DataFrame) -> DataFrame:
    """(query_id, policy, clause_id, score): BM25 within each policy, for clauses that share a term with the query.

    Of the words of the clauses only those that are asked for in their policy leave the row
    that they stand in. Where few are asked for, tasks count them as they read the texts,
    once, and nothing but the counts is shuffled, to be scored; otherwise words are
    shuffled to their clause.
    """
    spark = clauses.sparkSession
    asked = stored(queries.select("query_id", "policy", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")), folder(spark, "asked"))
    few = asked.count() <= FEW
    small = lambda df: F.broadcast(df) if few else df.hint("merge")
    sought, row = asked.select("policy", "term").distinct(), ["policy", "clause_id", "dl"]
    if few:
        words = stored(_asked_words(clauses, sought), folder(spark, "words"))
        held = words.where(F.size("terms") > 0)
        found = held.select(*row, F.inline("terms"))
        apart = bool(held.groupBy(*row).count().where("count > 1").limit(1).count())
    else:
        words = clauses.select("policy", "clause_id", F.size(tokens(F.col("text"))).alias("dl"), tokens(F.col("text")).alias("w"))
        found = words.select(*row, F.explode("w").alias("term")).join(small(sought), ["policy", "term"], "left_semi").withColumn("tf", F.lit(1))
        apart = True
    if apart:  # counts of a clause are brought together
        tf = found.repartition("policy", "clause_id").groupBy(*row, "term").agg(F.sum("tf").alias("tf"))
        held = tf.groupBy(*row).agg(F.collect_list(F.struct("term", "tf")).alias("terms"))
    stats = words.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    held = stored(held, folder(spark, "terms"))
    df = held.select("policy", F.explode("terms.term").alias("term")).groupBy("policy", "term").agg(F.count(F.lit(1)).alias("df"))
    told = asked.join(df.hint("merge"), ["policy", "term"]).join(F.broadcast(stats), "policy")
    each = held.repartition("policy", "clause_id").select("policy", "clause_id", "dl", F.explode("terms").alias("t")).select("policy", "clause_id", "dl", "t.term", "t.tf")
    hits = each.join(small(told), ["policy", "term"])
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.withColumn("part", part).groupBy("query_id", "policy", "clause_id").agg(F.sum("part").alias("score"))


def bm25_topk(queries: DataFrame, clauses: DataFrame, k: int = 20) -> DataFrame:
    # Scores are ranked to nine decimals, so that the order of a sum does not decide.
    return top_k(bm25(queries, clauses).withColumn("score", F.round("score", 9)), k)


# ---- vectors


def bucket(word: Column, size: int) -> Column:
    """The place of a word among ``size`` places, by the first six hexadecimal digits of its md5."""
    return (F.conv(F.substring(F.md5(word), 1, 6), 16, 10).cast("long") % size).cast("int")


def _word_counts(df: DataFrame, keys: list[str], text: Column, size: int) -> DataFrame:
    return df.select(*keys, F.explode(tokens(text)).alias("word")).groupBy(*keys, bucket(F.col("word"), size).alias("b")).agg(F.count(F.lit(1)).alias("tf"))


def fit_idf(df: DataFrame, keys: list[str], text: str = "text", size: int = 256) -> DataFrame:
    """(b, idf): ln((n + 1) / (df + 1)) of each place over the rows of df; at most ``size`` rows."""
    held = _word_counts(df, keys, F.col(text), size).groupBy("b").agg(F.count(F.lit(1)).alias("df"))
    n = df.agg(F.count(F.lit(1)).alias("n"))  # one row
    return held.crossJoin(F.broadcast(n)).select("b", F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)).alias("idf"))


def embed(df: DataFrame, keys: list[str], idf: DataFrame, text: str = "text", size: int = 256, prefix: str = "") -> DataFrame:
    """(keys, vec): unit vectors of hashed word counts, weighted by a fitted ``idf``.

    ``prefix`` is put before the text, as queries get an instruction and documents do
    not. Rows whose words all weigh nothing have a zero vector. Words of a row are counted
    before the shuffle, so a row moves as ``size`` numbers at most, however long its text.
    """
    weighted = _word_counts(df, keys, F.concat(F.lit(prefix), F.col(text)), size).join(F.broadcast(idf), "b")
    weighted = weighted.withColumn("w", F.col("tf") * F.col("idf"))
    entries = weighted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("b", "w"))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    joined = df.select(*keys).join(entries.hint("merge"), keys, "left")
    unit = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm"))
    zeros = F.array_repeat(F.lit(0.0), size)
    return joined.select(*keys, F.when(F.col("norm") > 0, unit).otherwise(zeros).alias("vec"))


def embed_with(df: DataFrame, load: Callable[[], Callable], text: str = "text", prefix: str = "") -> DataFrame:
    """Add ``vec`` by a model. ``load()`` is called once in each task and gives a function from a list of texts to a matrix; null texts are empty ones."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(list(model([prefix + (t or "") for t in batch])))

    return df.withColumn("vec", vectors(F.col(text)))


def score_with(candidates: DataFrame, load: Callable[[], Callable], query: str = "query_text", text: str = "text") -> DataFrame:
    """Add ``score`` by a model that reads pairs: ``load()`` gives, once in each task, a function from (queries, texts) to numbers. A scorer for rerank."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in batches:
            yield pd.Series(model(queries.tolist(), texts.tolist()), dtype=float)

    return candidates.withColumn("score", scores(F.col(query), F.col(text)))


#: Parts into which the rows of a policy are dealt for the exact way, and queries that are scored at once.
BLOCKS, CHUNK = 16, 256


def _vectors_by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (places, matrix)} of a column of vectors; those that are null or hold a null are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    gaps = np.asarray(pc.is_null(flat))
    owner = np.repeat(np.arange(len(column)), sizes)
    whole = np.asarray(pc.is_valid(column)) & (np.bincount(owner, weights=gaps, minlength=len(column)) == 0)
    values, starts = np.asarray(pc.fill_null(flat, 0.0)), np.concatenate(([0], np.cumsum(sizes)))[:-1]
    told = {}
    for size in np.unique(sizes[whole]):
        places = np.flatnonzero(whole & (sizes == size))
        told[int(size)] = places, values[starts[places][:, None] + np.arange(size)[None, :]].reshape(len(places), int(size))
    return told


def _best(k: int, itself: bool, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For the queries and rows of one group: the k best rows of each query, as (query_id, policy, clause_id, score)."""

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("clause_id")
        own, ids = asked["query_id"].to_numpy(zero_copy_only=False), known["clause_id"].to_numpy(zero_copy_only=False)
        queries, rows = _vectors_by_length(asked["q"]), _vectors_by_length(known["vec"])
        found = []
        for start in range(0, asked.num_rows if known.num_rows else 0, CHUNK):
            stop = min(start + CHUNK, asked.num_rows)
            # Vectors of unequal lengths, or with nulls, have no score and come last.
            scores, told = np.full((stop - start, len(ids)), -np.inf), np.zeros((stop - start, len(ids)), bool)
            for size in queries.keys() & rows.keys():
                (at, q), (to, v) = queries[size], rows[size]
                here = (at >= start) & (at < stop)
                cells = np.ix_(at[here] - start, to)
                scores[cells], told[cells] = np.round(q[here] @ v.T, 9), True
            order = np.where(np.isnan(scores), np.inf, scores)
            met = np.ones(order.shape, bool) if itself else (own[start:stop, None] != ids[None, :])
            least = -np.inf
            if len(ids) > k + 1:
                # One more than k, since a query may stand among the rows.
                least = np.partition(order, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1][:, None]
            at, to = np.nonzero((order >= least) & met)
            sort = np.lexsort((to, -order[at, to], at))  # rows are in the order of their ids
            at, to = at[sort], to[sort]
            first = np.searchsorted(at, at)
            keep = np.arange(len(at)) - first < k
            at, to = at[keep], to[keep]
            score = pa.array(scores[at, to], mask=~told[at, to])
            found.append(pa.table([asked["query_id"].take(at + start), asked["policy"].take(at + start), known["clause_id"].take(to), score], schema.names).cast(schema))
        return pa.concat_tables(found) if found else schema.empty_table()

    return run


def _best_of_groups(asked: DataFrame, known: DataFrame, by: list[str], k: int, itself: bool) -> DataFrame:
    """The k best pairs of each query among the rows that share ``by`` (which holds the policy) with it, by dot product, to nine decimals,
    so that the order of a sum does not decide. Pairs stay in the task that meets them: only the best of a group leave it."""
    if not itself:
        asked, known = asked.where(F.col("query_id").isNotNull()), known.where(F.col("clause_id").isNotNull())
    schema = StructType([asked.schema["query_id"], asked.schema["policy"], known.schema["clause_id"], StructField("score", DoubleType())])
    schema = StructType([StructField(f.name, f.dataType) for f in schema])
    return asked.groupBy(*by).cogroup(known.groupBy(*by)).applyInArrow(_best(k, itself, to_arrow_schema(schema)), schema)


def dense_topk(queries: DataFrame, rows: DataFrame, k: int = 20, itself: bool = True) -> DataFrame:
    """(query_id, policy, clause_id, score, rank) by dot product among the rows (policy, clause_id, vec) of the query's policy: exact, each query meets all of them.

    The rows of a policy are dealt into BLOCKS parts, each query goes to all of them; of each
    part the k best leave it, so what moves grows with queries and rows, not with pairs.
    """
    part = F.pmod(F.xxhash64("clause_id"), F.lit(BLOCKS)).cast("int")
    asked = queries.where("policy IS NOT NULL").select("query_id", "policy", F.col("vec").cast("array<double>").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("part"))
    known = rows.where("policy IS NOT NULL").select("policy", "clause_id", F.col("vec").cast("array<double>").alias("vec"), part.alias("part"))
    return top_k(_best_of_groups(asked, known, ["policy", "part"], k, itself), k)


def lsh_topk(queries: DataFrame, rows: DataFrame, k: int = 20, width: float = 1.0, together: int = 4, tables: int = 64, seed: int = 7, itself: bool = True) -> DataFrame:
    """The same by locality-sensitive hashing: only rows that share a bucket with the query are met, and these are scored exactly.

    Buckets of random projections (``width``) come from Spark ML; a key is ``together`` of
    them and the policy, and one of ``tables`` keys has to agree. Vectors go to their buckets
    and are scored there; the k best of each bucket leave it. Recall is measured by
    ``recall_of`` against dense_topk, which is the exact way. More tables or wider buckets
    find more.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    lsh = BucketedRandomProjectionLSH(inputCol="v", outputCol="hashes", bucketLength=width, numHashTables=together * tables, seed=seed)
    known = rows.withColumn("v", array_to_vector("vec"))
    model = lsh.fit(known)

    def keyed(df: DataFrame) -> DataFrame:
        cells = F.transform("hashes", lambda h: vector_to_array(h)[0].cast("int"))
        told = model.transform(df).withColumn("cells", cells)
        keys = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.xxhash64(t, F.slice("cells", t * together + 1, together)))
        return told.withColumn("key", F.explode(keys)).drop("v", "hashes", "cells")

    asked = keyed(queries.where("policy IS NOT NULL").select("query_id", "policy", "vec").withColumn("v", array_to_vector("vec")))
    asked = asked.select("query_id", "policy", "key", F.col("vec").cast("array<double>").alias("q"))
    known = keyed(known.where("policy IS NOT NULL").select("policy", "clause_id", "vec", "v"))
    known = known.select("policy", "clause_id", "key", F.col("vec").cast("array<double>").alias("vec"))
    # A pair that meets in several buckets has one score.
    met = _best_of_groups(asked, known, ["policy", "key"], k, itself)
    return top_k(met.groupBy("query_id", "policy", "clause_id").agg(F.max("score").alias("score")), k)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(policy, n, hit): how many of the exact rows of each policy were found."""
    keys = ["query_id", "policy", "clause_id"]
    told = exact.select(*keys).join(found.select(*keys).withColumn("hit", F.lit(1)).hint("merge"), keys, "left")
    return told.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hit"))


def fuse_rrf(lists: list[tuple[DataFrame, float]]) -> DataFrame:
    """(query_id, policy, clause_id, score): weighted reciprocal ranks over several ranked lists."""
    parts = [df.select("query_id", "policy", "clause_id", (F.lit(w) / (RRF + F.col("rank"))).alias("part")) for df, w in lists]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("query_id", "policy", "clause_id").agg(F.sum("part").alias("score"))


def overlap(a: Column, b: Column) -> Column:
    """Shared distinct words over the root of the product of their numbers: the default scorer, squared and in millionths."""
    common = F.size(F.array_intersect(a, b)).cast("long")
    return F.floor(common * common * 1_000_000 / F.greatest(F.size(a) * F.size(b), F.lit(1))).cast("long")


def rerank(candidates: DataFrame, top_n: int = 3, scorer: Callable | None = None, matched: bool = False) -> DataFrame:
    """(query_id, policy, clause_id, score, rank): the best window of each clause, then the best clauses.

    candidates: (query_id, policy, clause_id, window, q_words, words). A scorer is a
    function from them to the same rows with a ``score`` (see score_with); without one
    words are compared. With ``matched`` the text of the best window comes along.
    """
    scored = scorer(candidates) if scorer else candidates.withColumn("score", overlap(F.col("q_words"), F.col("words")))
    text = [F.max_by("text", F.struct("score", -F.col("window"))).alias("matched")] if matched else []
    best = scored.groupBy("query_id", "policy", "clause_id").agg(F.max(F.struct("score", -F.col("window"))).alias("b"), *text)
    return top_k(best.select("query_id", "policy", "clause_id", F.col("b.score").alias("score"), *["matched"] * matched), top_n)


def follow_refs(hits: DataFrame, refs: DataFrame, limit: int = 4) -> DataFrame:
    """Hits with up to ``limit`` clauses of their policy that they name (policy, clause_id, refs), in the order of hits and of their refs, score 0."""
    joined = hits.hint("merge").join(refs, ["policy", "clause_id"])
    named = joined.select("query_id", "policy", "rank", F.posexplode("refs").alias("pos", "ref"), F.col("clause_id").alias("via"))
    known = hits.select("query_id", "policy", F.col("clause_id").alias("ref"))
    fresh = named.hint("merge").join(known, ["query_id", "policy", "ref"], "left_anti")
    first = fresh.groupBy("query_id", "policy", "ref").agg(F.min(F.struct("rank", "pos", "via")).alias("f"))
    order = Window.partitionBy("query_id").orderBy("f.rank", "f.pos")
    added = first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    more = added.select("query_id", "policy", F.col("ref").alias("clause_id"), F.lit(0).cast("long").alias("score"), F.col("f.via").alias("via_ref_of"))
    return hits.select("query_id", "policy", "clause_id", "score", F.lit(None).cast("long").alias("via_ref_of")).unionByName(more)


def search(
    queries: DataFrame,
    clauses: DataFrame,
    refs: DataFrame,
    write: Callable[[DataFrame, str], DataFrame],
    vectors: tuple[DataFrame, DataFrame] | None = None,
    scorer: Callable | None = None,
    k: int = 20,
    top_n: int = 3,
    weights: tuple = (0.6, 0.4),
    cut: int = 900,
    prefix: str = "",
) -> DataFrame:
    """(query_id, policy, clause_id, score, via_ref_of, matched): hybrid search of a table of queries, each within its policy.

    The ``k`` best clauses by vectors and by BM25 are fused by reciprocal ranks (0.6 and
    0.4), the fused ones are cut into windows and reranked, the best ``top_n`` clauses come
    with the window that matched, and clauses that they name are added with ``cut``
    characters of their text. ``vectors`` are those of (queries, clauses); without them
    hashed words with fitted weights are used, and ``prefix`` goes before the queries only.
    Clauses are known by (policy, clause_id); hits that are none of ``clauses`` are dropped.
    The fused candidates are written once, all later steps read them.
    """
    if vectors is None:
        idf = write(fit_idf(clauses, ["policy", "clause_id"]), "idf")
        vectors = embed(queries, ["query_id", "policy"], idf, prefix=prefix), embed(clauses, ["policy", "clause_id"], idf)
    dense = dense_topk(*vectors, k)
    fused = write(fuse_rrf([(dense, weights[0]), (bm25_topk(queries, clauses, k), weights[1])]), "fused")
    # Texts are read where they lie: ids go to them, and only those of candidates are cut.
    ids = write(fused.select("policy", "clause_id").distinct(), "ids")
    named = clauses.select("policy", "clause_id", *[c for c in ("title", "text") if c in clauses.columns]).join(near(ids), ["policy", "clause_id"], "left_semi")
    windows = sub_chunk(named.dropDuplicates(["policy", "clause_id"]))
    words = queries.select("query_id", "policy", F.col("text").alias("query_text"), F.array_distinct(tokens(F.col("text"))).alias("q_words"))
    pairs = fused.select("query_id", "policy", "clause_id").join(words.hint("merge"), ["query_id", "policy"])
    pairs = pairs.join(windows.withColumn("words", F.array_distinct(tokens(F.col("text")))).hint("merge"), ["policy", "clause_id"])
    best = write(rerank(pairs, top_n, scorer, matched=True), "reranked")
    followed = follow_refs(best, refs).join(best.select("query_id", "policy", "clause_id", "matched").hint("merge"), ["query_id", "policy", "clause_id"], "left")
    followed = write(followed, "followed")
    known = clauses.select("policy", "clause_id", F.substring("text", 1, cut).alias("preview")).join(near(followed), ["policy", "clause_id"])
    return known.select("query_id", "policy", "clause_id", "score", "via_ref_of", F.coalesce("matched", "preview").alias("matched"))


def drop_unknown(hits: DataFrame, clauses: DataFrame) -> DataFrame:
    """Hits that are clauses of their own policy."""
    return hits.hint("merge").join(clauses.select("policy", "clause_id"), ["policy", "clause_id"], "left_semi")


def below_threshold(hits: DataFrame, least: int) -> DataFrame:
    """Queries whose best score is under ``least``."""
    return hits.groupBy("query_id").agg(F.max("score").alias("best")).where(F.col("best") < least)


def search_text(item: Column) -> Column:
    """An item without rates, parentheses and figures of four digits or more; the item itself where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(item, r"\([^)]*\)", " "), r"@ ?[0-9.,]+", " "), r"[0-9]{4,}", " ")
    bare = F.trim(F.regexp_replace(bare, r" +", " "))
    return F.when(bare == "", item).otherwise(bare)


def build_queries(lines: DataFrame, templates: DataFrame, attempt: int) -> DataFrame:
    """Add ``query``: the template of (route, attempt) with the item filled in; attempts beyond the last use the last."""
    used = templates.where(F.col("attempt") == min(attempt, 2)).drop("attempt")
    joined = lines.join(F.broadcast(used), "route")
    return joined.withColumn("query", F.replace("template", F.lit("{item}"), search_text(F.col("item")))).drop("template")


def naive_query(lines: DataFrame) -> DataFrame:
    return lines.withColumn("query", F.concat("item", F.lit(" limit coverage")))


def recall_at_k(ranked: DataFrame, key: DataFrame) -> DataFrame:
    """(policy, n, hit3, hit20): keys (query_id, policy, clause_id) found in the first 3 and 20; null policy: all.

    Ranked rows that carry a policy count for the key's policy only, since two policies may number alike.
    """
    on = ["query_id", *(["policy"] if "policy" in ranked.columns else []), "clause_id"]
    found = key.join(ranked.select(*on, "rank").hint("merge"), on, "left")
    return found.rollup("policy").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank") <= 3).alias("hit3"), F.count_if(F.col("rank") <= 20).alias("hit20")
    )


def topic_clauses(lines: DataFrame, topics: DataFrame, clauses: DataFrame) -> DataFrame:
    """(bill_id, line_no, clause_id, place): clauses that hand-made topics (pattern, ids) name for a line and the corpus has.

    Topics that carry a policy speak to lines of that policy only, and their ids are ids of
    its clauses. Topics are a rule pack of some hundred rows.
    """
    own = ["policy"] if "policy" in topics.columns else []
    # The few ids of the topics go to the clauses; lines meet those that are known and move once, to themselves.
    told = topics.select("pattern", "priority", *own, F.posexplode("ids").alias("pos", "clause_id"))
    known = F.broadcast(clauses.select(*own, "clause_id").join(F.broadcast(told.select(*own, "clause_id").distinct()), [*own, "clause_id"], "left_semi").distinct())
    places = told.join(known, [*own, "clause_id"], "left_semi").groupBy("pattern", "priority", *own).agg(F.collect_list(F.struct("priority", "pos", "clause_id")).alias("places"))
    speaks = F.expr("rlike(item, pattern)" + (" AND policy = __policy" if own else ""))
    hit = lines.join(F.broadcast(places.withColumnRenamed("policy", "__policy")), speaks).select("bill_id", "line_no", *own, F.explode("places").alias("p"))
    each = hit.select("bill_id", "line_no", *own, "p.clause_id", F.struct("p.priority", "p.pos").alias("f")).repartition("bill_id", "line_no")
    first = each.groupBy("bill_id", "line_no", *own, "clause_id").agg(F.min("f").alias("f"))
    order = Window.partitionBy("bill_id", "line_no").orderBy("f")
    return first.select("bill_id", "line_no", "clause_id", F.row_number().over(order).alias("place"))


def browse_clauses(clauses: DataFrame, pattern: str, width: int = 420) -> DataFrame:
    return clauses.where(F.col("text").rlike(pattern)).select("policy", "clause_id", F.substring("text", 1, width).alias("preview"))
