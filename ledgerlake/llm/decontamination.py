"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask laid over consecutive words: words under a 1 are hashed, those
under a 0 are ignored. So a passage in which some words were replaced still shares
seeds with the benchmark item it came from, wherever the replaced words fall under
zeros of one of the masks. Seeds of all documents are joined with those of all items;
around each hit the two texts are laid side by side, and the longest stretch of words
of which 80 % are equal is found. It is an overlap if it has MIN_OVERLAP words (or the
whole item, if that is shorter). Every overlap of this kind holds a seed, wherever its
replaced words stand: the masks are chosen so, and a test tries all places.

A bit table of fixed size (4 MB), set by the items' seeds, spares most document seeds
the shuffle; it lets every true hit through. The join decides by the full hashes, and
the verification by the words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import Scratch, join_by_key, release, slices
from ledgerlake.llm.near_dedup import _ODD, mix, word_hashes

_U = np.uint64
# The masks. Of 13 to 25 words with a fifth replaced at most, four in a row
# are equal, or two threes with one word between (15 words). Longer overlaps hold such a
# shorter one. Items of 5 to 12 words need more masks at three lengths only;
# of those under 5 no word may differ. The masks of short items are laid over these items only.
MASKS = ("1111", "1110111")
SHORT_MASKS = {1: ("1",), 2: ("11",), 3: ("111",), 5: ("11011", "10111", "11101"), 6: ("111011", "110111"), 10: ("111011", "110111")}
MIN_OVERLAP, PERCENT = 13, 80
BITS = 25
#: Benchmark rows of seeds, or of hits, up to which they are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Hits of one document that are gathered in one row.
GATHERED = 1_000


def masks_for(lengths: list[int], min_overlap: int = MIN_OVERLAP, percent: int = PERCENT) -> list[str]:
    """Masks of which one fits every overlap the rule allows; ``lengths`` are those of items under min_overlap."""
    if percent >= PERCENT and min_overlap >= MIN_OVERLAP:
        return list(dict.fromkeys([*MASKS, *(m for n in lengths for m in SHORT_MASKS.get(n, ()))]))
    # Other rules: the run of equal words that n words with so many others cannot do without.
    other = {n: (100 - percent) * n // 100 for n in [*lengths, *range(min_overlap, 2 * min_overlap)]}
    return ["1" * max(1, min(8, *(-(-(n - m) // (m + 1)) for n, m in other.items())))]


def sizes_of(mask: str, masks: list[str], lengths: list[int]) -> list[int] | None:
    """The lengths of items that a mask is for: None for all of them, else the short ones that need it."""
    return None if mask in MASKS or len(masks) == 1 else [n for n in lengths if mask in SHORT_MASKS.get(n, ())]


def first_places(seed: np.ndarray, text: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Where each seed of a text comes first."""
    order = np.lexsort((place, seed, text))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(text[order]) != 0) | (seed[order][1:] != seed[order][:-1])
    return order[new]


def seeds(words: np.ndarray, offsets: np.ndarray, masks: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, text, place) of all seeds of a batch of texts: one triple of arrays for each mask."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.arange(len(words)) - np.repeat(offsets[:-1], np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(words))
    out = []
    for mask in masks:
        picks, n = [i for i, c in enumerate(mask) if c == "1"], len(words) - len(mask) + 1
        if n <= 0:
            continue
        total = np.full(n, _U(int(mask, 2)), dtype=_U)
        for k, i in enumerate(picks):
            total = total + words[i : n + i] * _ODD[k]
        at = np.flatnonzero(left[:n] >= len(mask))
        out.append((mix(total[at]), text[at], place[at]))
    return out


def longest_stretch(equal: np.ndarray, percent: int, least: int) -> tuple[int, int, int]:
    """(start, end, equal words) of the longest stretch of which ``percent`` are equal.

    Unequal words at its ends are left out as far as ``least`` words stay.
    """
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 100 - percent, -percent))])
    # For each end the first start whose sum is not above: the lowest sums so far fall, so they can be searched.
    first = np.searchsorted(-np.minimum.accumulate(sums), -sums)
    end = int(np.argmax(np.arange(len(sums)) - first))
    start = int(first[end])
    while end - start > least and not equal[end - 1]:
        end -= 1
    while end - start > least and not equal[start]:
        start += 1
    return start, end, int(equal[start:end].sum())


def _bit_table(hashes: DataFrame):
    """2^BITS bits, one set for each hash: built where the seeds are, and merged."""
    size = 1 << (BITS - 3)

    def build(batches):
        bits = np.zeros(1 << BITS, dtype=bool)
        for batch in batches:
            bits[(batch.column(0).to_numpy().view(_U) >> _U(64 - BITS)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["one", "bits"])

    table = np.zeros(size, dtype=np.uint8)
    # The items' seeds lie in few partitions: 16 tables of 4 MB at most.
    for row in hashes.select("seed").coalesce(16).mapInArrow(build, "one int, bits binary").toLocalIterator():
        table |= np.frombuffer(row["bits"], dtype=np.uint8)
    return table.tobytes()


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    min_overlap: int = MIN_OVERLAP,
    percent: int = PERCENT,
) -> DataFrame:
    """(id, item, start_word, n_words, n_equal): the longest overlap of each document with each item it holds.

    start_word counts the document's words from 0. Words are what ASCII white space
    separates, A-Z in lower case. Items under ``min_overlap`` words are found where
    ``percent`` of the whole item stand in place (of under five words all must, at 80);
    null ones and those without words take no part. Null ids, null and empty texts have
    no overlap. Ids are meant to be unique: equal rows give one. Of overlaps of one
    document with one item the one with most equal words is told, then the longer, then
    the first. Other columns are dropped, whatever their names. Without documents or
    items the result is empty. A very long text takes about 100 bytes of a worker's
    memory for each of its words.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    bench = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")

    def item_words(batches):
        for batch in batches:
            words, offsets = word_hashes(batch.column(1))
            lists = [words[a:b].astype(np.int64) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["item", "item_words"])

    words = scratch.table(bench.mapInArrow(item_words, "item long, item_words array<long>").where(F.size("item_words") > 0), "items")
    lengths = sorted(r[0] for r in words.where(F.size("item_words") < min_overlap).select(F.size("item_words")).distinct().collect())  # under min_overlap numbers
    masks = masks_for(lengths, min_overlap, percent)
    meant = {mask: sizes_of(mask, masks, lengths) for mask in masks}
    # A mask that is the whole item: one place in a document is as good as all, the first is told.
    whole_item = {mask for mask, n in meant.items() if n == [len(mask)] and "0" not in mask}

    def item_seeds(batches):
        for batch in batches:
            lists = batch.column(1)
            flat, offsets = lists.flatten().to_numpy().view(_U), lists.offsets.to_numpy()
            ids, sizes = batch.column(0).to_numpy(), np.diff(offsets).astype(np.int32)
            for mask in masks:
                for seed, text, place in seeds(flat, offsets - offsets[0], [mask]):
                    own = np.flatnonzero(np.isin(sizes[text], meant[mask])) if meant[mask] is not None else np.arange(len(text))
                    columns = seed[own].astype(np.int64), ids[text[own]], place[own].astype(np.int32), sizes[text[own]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["seed", "item", "q", "size"])

    known = scratch.table(words.mapInArrow(item_seeds, "seed long, item long, q int, size int").distinct(), "seeds")
    table = spark.sparkContext.broadcast(_bit_table(known))  # 4 MB

    def doc_seeds(batches):
        bits = np.frombuffer(table.value, dtype=np.uint8)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            words, offsets = word_hashes(batch.column(1))
            ids = batch.column(0).to_numpy()
            for mask in masks:
                for seed, text, place in seeds(words, offsets, [mask]):
                    bit = (seed >> _U(64 - BITS)).astype(np.int64)
                    hit = np.flatnonzero((bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1)
                    if mask in whole_item:
                        hit = hit[first_places(seed[hit], text[hit], place[hit])]
                    yield pa.RecordBatch.from_arrays([pa.array(seed[hit].astype(np.int64)), pa.array(ids[text[hit]]), pa.array(place[hit].astype(np.int32))], names=["seed", "id", "p"])
        release()

    small = known.count() <= BROADCAST_ROWS
    found = texts.mapInArrow(doc_seeds, "seed long, id long, p int")
    hits = found.join(F.broadcast(known) if small else known.hint("merge"), "seed")
    # Laid side by side, item word j stands at document word j + shift.
    hits = scratch.table(hits.select("id", "item", "size", (F.col("p") - F.col("q")).alias("shift")).distinct(), "hits")
    total = hits.count()
    per_doc = scratch.table(hits.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "per_doc")
    part = F.pmod(F.xxhash64("item", "shift"), F.ceil(F.col("n") / GATHERED))
    by_doc = join_by_key(hits, per_doc, "id", "n", total).groupBy("id", part.alias("part"))
    by_doc = scratch.table(by_doc.agg(F.collect_list(F.struct("item", "shift", "size")).alias("hits")).drop("part"), "by_doc")
    joined = texts.join(F.broadcast(by_doc) if total <= BROADCAST_ROWS else by_doc.hint("merge"), "id").select("id", "text", "hits")

    def beside(batches):
        """The words of the document that stand beside those of the item, for each hit."""
        for batch in (part for whole in batches for part in slices(whole, 1)):
            words, offsets = word_hashes(batch.column(1))
            out = []
            for i, (doc, hits) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                own = words[offsets[i] : offsets[i + 1]]
                for hit in hits:
                    a, b = max(0, -hit["shift"]), min(hit["size"], len(own) - hit["shift"])
                    out.append((doc, hit["item"], hit["shift"], a, own[a + hit["shift"] : b + hit["shift"]].tobytes()))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "item", "shift", "a", "own"])
        release()

    each = scratch.table(joined.mapInArrow(beside, "id long, item long, shift int, a int, own binary"), "beside")
    per_item = each.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    told = scratch.table(words.dropDuplicates(["item", "item_words"]).join(per_item.hint("merge"), "item"), "told")

    def verify(batches):
        for batch in (part for whole in batches for part in slices(whole, 4)):
            out = []
            for doc, item, shift, a, own, whole in zip(*(c.to_pylist() for c in batch.columns)):
                own, whole = np.frombuffer(own, dtype=_U), np.array(whole, dtype=np.int64).view(_U)
                least, b = min(min_overlap, len(whole)), min(len(whole), a + len(own))
                start, end, equal = longest_stretch(whole[a:b] == own[: b - a], percent, least)
                if end - start >= least:
                    out.append((doc, item, a + start + shift, end - start, equal))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "item", "start_word", "n_words", "n_equal"])
        release()

    paired = join_by_key(each, told, "item", "n", each.count()).select("id", "item", "shift", "a", "own", "item_words")
    rows = paired.mapInArrow(verify, "id long, item long, start_word long, n_words long, n_equal long")
    best = rows.groupBy("id", "item").agg(F.max(F.struct("n_equal", "n_words", (-F.col("start_word")).alias("s"))).alias("b"))
    return best.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("b.s")).alias("start_word"),
        F.col("b.n_words").alias("n_words"), F.col("b.n_equal").alias("n_equal"),
    )


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items, and where."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
