"""Line dedup by an exact set-similarity join.

A line is the set of its words (A-Z in lower case, separated by ASCII white space).
A line is removed if some earlier line (smaller document id, then smaller line
number) has a Jaccard similarity of ``percent`` / 100 or more with it.

1. *Rarity.* Words are counted in 2^22 hashed buckets, over all texts. Every line's words are ordered
   by (bucket count, hash), rarest first: one order for all lines, whose table has a
   fixed size at any size of the corpus.
2. *Classes.* Equal sets are one class, with its first line. Later lines of a class go.
3. *Prefix filter.* Two sets that are similar enough share a word among the first
   n - ceil(t n) + 1 of each. Words whose bucket counts 1 occur nowhere else.
4. *Length and positional filters* hold for each shared word within the join, as does a
   bound from 128 parity bits of each set: sets differ in at least as many words as
   their bits differ.
5. *Verification.* What passes is compared on the full sets.

A word whose bucket counts at most COLD has a list that cannot be longer. Such lists are
shuffled by their word and joined as they stream by, each sorted by the sizes of its sets,
so that only sizes which can match are paired at all. For the other words each line is first compared with the PIVOTS earliest
lines of the list only, which settles most lines of a large group of variants; only
lines that are still open meet the whole list. All lists stay whole. Of a line's
candidates the one that promises most is verified first, the others only if it fails:
one match is enough.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import Scratch, dealt, fresh, join_by_key, release, slices
from ledgerlake.llm.near_dedup import BROADCAST_IDS, word_hashes

_U = np.uint64
#: Buckets of the rarity table, in blocks that are summed apart.
BUCKETS, BLOCKS = 1 << 22, 64
COLD, PIVOTS, MIN_WORDS, PERCENT = 1024, 8, 1, 80
#: Tables of counts that are added up in one step.
ADDED = 32


def _lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All lines of a batch of texts, the row and the number within its text of each."""
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(counts)), counts)
    return lists.flatten(), row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _sets(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each line as sorted hashes, and where each line's begin."""
    words, offsets = word_hashes(lines)
    line = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    # One number to sort by: the line and the first 40 bits of the hash.
    order = np.argsort((line.astype(_U) << _U(40)) | (words >> _U(24)), kind="stable")
    sorted_ = words[order]
    if ((sorted_[1:] < sorted_[:-1]) & (line[1:] == line[:-1])).any():  # two words share these bits
        sorted_ = words[np.lexsort((words, line))]
    new = np.ones(len(words), dtype=bool)
    new[1:] = (sorted_[1:] != sorted_[:-1]) | (line[1:] != line[:-1])
    return sorted_[new], np.searchsorted(line[new], np.arange(len(offsets)))


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words >> _U(42)).astype(np.int64)


def _coded(counts) -> np.ndarray:
    """Counts as one byte each: exact up to 127, then eight steps for each doubling."""
    counts = np.asarray(counts, dtype=float)
    return np.where(counts < 128, counts, np.minimum(255, 127 + 8 * np.log2(np.maximum(counts, 128) / 128))).astype(np.uint8)


def rarity(docs: DataFrame) -> np.ndarray:
    """How often the words of each bucket occur in lines, one byte each.

    Each task gives one table in BLOCKS blocks. Tables are added up in steps, dealt by
    the number of their partition, so that a task that runs again gives the same rows.
    """
    size = BUCKETS // BLOCKS

    def count(batches):
        from pyspark import TaskContext

        total = np.zeros(BUCKETS, dtype=np.uint32)
        for batch in (part for whole in batches for part in slices(whole, 0)):
            words, _ = word_hashes(batch.column(0))  # all occurrences: no list of lines can be longer
            np.add.at(total, _bucket(words), np.uint32(1))
        part = [TaskContext.get().partitionId() // ADDED] * BLOCKS
        blocks = [b.tobytes() for b in total.reshape(BLOCKS, size)]
        del total
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(BLOCKS), pa.int32()), pa.array(part, pa.int32()), pa.array(blocks, pa.binary())], names=["block", "part", "counts"]
        )
        release()

    def added(table: pa.Table) -> np.ndarray:
        total = np.zeros(size, dtype=np.uint64)
        for counts in table.column("counts"):
            total += np.frombuffer(counts.as_buffer(), dtype=np.uint32)
        return np.minimum(total, 0xFFFFFFFF).astype(np.uint32)

    def add(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1)
        part = pc.cast(pc.divide(first["part"], ADDED), pa.int32())
        return pa.table({"block": first["block"], "part": part, "counts": pa.array([added(table).tobytes()], pa.binary())})

    def last(table: pa.Table) -> pa.Table:
        return pa.table({"block": table["block"].slice(0, 1), "counts": pa.array([_coded(added(table)).tobytes()], pa.binary())})

    kind = "block int, part int, counts binary"
    parts = docs.select("text").mapInArrow(count, kind)
    for _ in range(2):  # ADDED^2 partitions become one table
        parts = parts.groupBy("block", "part").applyInArrow(add, kind)
    rows = parts.groupBy("block").applyInArrow(last, "block int, counts binary").collect()  # 4 MB at any size of the corpus
    total = np.zeros((BLOCKS, size), dtype=np.uint8)
    for r in rows:
        total[r["block"]] = np.frombuffer(r["counts"], dtype=np.uint8)
    return total.ravel()


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's first words must be looked at: n - ceil(percent n / 100) + 1."""
    return n - (percent * n + 99) // 100 + 1


def _line_rows(docs: DataFrame, table, percent: int, min_words: int) -> DataFrame:
    """A row for each line that counts: class, id, line, n, parity bits, and prefix words that may occur elsewhere.

    A prefix word is the first 32 bits of its hash: words that share them share their
    bucket too, so lists keep their bound, and pairs that meet by chance fail the filters
    or the verification. ``left`` counts a prefix word and the words after it.
    """

    def run(batches):
        import xxhash

        counts = table.value
        for batch in (part for whole in batches for part in slices(whole, 1)):
            lines, row, number = _lines(batch.column(1))
            words, starts = _sets(lines)
            n = np.diff(starts)
            line = np.repeat(np.arange(len(n)), n)
            count = counts[_bucket(words)]
            # By line, then count, then hash. Words come sorted by hash within a line, and the sort is stable.
            order = np.argsort((line.astype(_U) << _U(40)) | (count.astype(_U) << _U(32)) | (words >> _U(32)), kind="stable")
            place = np.arange(len(words)) - np.repeat(starts[:-1], n)
            ranked, ranked_count = words[order], count[order]
            # A set can be similar to another one only if one word more or less is allowed.
            joins = n * (100 - percent) >= percent
            use = (place < prefix_length(n, percent)[line]) & (ranked_count > 1) & joins[line]
            bit = np.left_shift(_U(1), words & _U(63))
            high = (words >> _U(6)) & _U(1)
            some = np.flatnonzero((n >= min_words) & (n > 0))
            # One zero more, where blank lines at the end begin: the line before them keeps its last word.
            bits = [np.bitwise_xor.reduceat(np.append(np.where(high == half, bit, _U(0)), _U(0)), starts[:-1]) for half in (_U(0), _U(1))]
            raw = words.tobytes()
            classes = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(starts[some].tolist(), starts[some + 1].tolist())]
            kept = np.flatnonzero(use)
            ends = np.searchsorted(line[kept], np.arange(len(n) + 1))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)) for values in (
                (ranked[kept] >> _U(32)).astype(np.uint32).view(np.int32), (n[line] - place)[kept].astype(np.int32), (ranked_count[kept] > _coded(COLD)).astype(bool))]
            take = pa.array(some)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(classes, pa.binary()), batch.column(0).take(pa.array(row[some])), pa.array(number[some].astype(np.int32)),
                    pa.array(n[some].astype(np.int32)), *[pa.array(b[some].astype(np.int64)) for b in bits], *[x.take(take) for x in lists],
                ],
                names=["class", "id", "line", "n", "b0", "b1", "words", "left", "hot"],
            )
        release()

    schema = "class binary, id long, line int, n int, b0 long, b1 long, words array<int>, left array<int>, hot array<boolean>"
    return docs.mapInArrow(run, schema)


def _needed_sets(docs: DataFrame, needed: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, line, set) of the lines (id, line) in ``needed``."""
    by_doc = scratch.table(needed.groupBy("id").agg(F.collect_set("line").alias("lines")), f"{name}-lines")
    few = by_doc.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0] <= BROADCAST_IDS
    joined = docs.join(F.broadcast(by_doc) if few else by_doc.hint("merge"), "id").select("id", "text", "lines")

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1)):
            lines, row, number = _lines(batch.column(1))
            lists = batch.column(2)
            wanted = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()) << 32 | lists.flatten().to_numpy()
            at = np.flatnonzero(np.isin(row << 32 | number, wanted))
            words, starts = _sets(lines.take(pa.array(at)))
            raw = words.tobytes()
            made = [raw[8 * a : 8 * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row[at])), pa.array(number[at].astype(np.int32)), pa.array(made, pa.binary())],
                names=["id", "line", "set"],
            )
        release()

    return scratch.table(joined.mapInArrow(run, "id long, line int, set binary").dropDuplicates(["id", "line"]), f"{name}-sets")


def _check(docs: DataFrame, pairs: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """(id, line) of the later lines of pairs whose full sets are similar enough."""
    ends = [pairs.select(F.col(f"{x}id").alias("id"), F.col(f"{x}line").alias("line")) for x in "ab"]
    sets = _needed_sets(docs, ends[0].union(ends[1]).distinct(), scratch, name)
    for x in "ab":
        side = sets.select(F.col("id").alias(f"{x}id"), F.col("line").alias(f"{x}line"), F.col("set").alias(f"{x}set"))
        pairs = pairs.join(side.hint("merge"), [f"{x}id", f"{x}line"])

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 2)):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, dtype=_U), np.frombuffer(y, dtype=_U)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], names=["id", "line"])
        release()

    chosen = pairs.select(F.col("aid").alias("id"), F.col("aline").alias("line"), "aset", "bset")
    return scratch.table(chosen.mapInArrow(run, "id long, line int").distinct(), f"{name}-found")


def _verified(docs: DataFrame, pairs: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """(id, line) of lines with a verified match among pairs (aid, aline, bid, bline, gap): the smallest gap first, then the rest."""
    best = pairs.groupBy("aid", "aline").agg(F.min(F.struct("gap", "bid", "bline")).alias("b"))
    best = scratch.table(best.select("aid", "aline", F.col("b.bid").alias("bid"), F.col("b.bline").alias("bline")), f"{name}-best")
    found = _check(docs, best, percent, scratch, f"{name}-1")
    done = found.select(F.col("id").alias("aid"), F.col("line").alias("aline"))
    rest = pairs.drop("gap").join(done.hint("merge"), ["aid", "aline"], "left_anti").join(best.hint("merge"), ["aid", "aline", "bid", "bline"], "left_anti")
    rest = scratch.table(rest, f"{name}-rest")
    if not rest.limit(1).count():
        return found
    return scratch.table(found.union(_check(docs, rest, percent, scratch, f"{name}-2")), f"{name}-all")


#: Parity bits on which the sets of a pair differ: the fewer, the more alike they may be.
_GAP = "bit_count(a.b0 ^ b.b0) + bit_count(a.b1 ^ b.b1)"


def _filters(percent: int):
    """The filters on a pair a, b that share a word, b the earlier line, in whole numbers and cheapest first.

    Similar sets share percent / (100 + percent) of the sum of their sizes. The words
    left of either set, from the shared one on, must suffice for that; this implies the
    length filter, since no set has more words left than it has words.
    """
    return F.expr(
        f"{100 + percent} * least(a.left, b.left) >= {percent} * (a.n + b.n)"
        f" AND (b.id < a.id OR (b.id = a.id AND b.line < a.line))"
        f" AND {100 + percent} * (a.n + b.n - ({_GAP})) >= {2 * percent} * (a.n + b.n)"
    )


def _pairs(a: DataFrame, b: DataFrame, percent: int, keys: tuple = ("word",)) -> DataFrame:
    """(aid, aline, bid, bline, gap) of lines that share a word and pass the filters."""
    same = functools.reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    joined = a.alias("a").join(b.alias("b").hint("merge"), same & _filters(percent))
    ends = [F.col(f"{x}.{c}").alias(f"{x}{c}") for x in "ab" for c in ("id", "line")]
    return joined.select(*ends, F.expr(f"1000 * ({_GAP}) DIV (a.n + b.n)").alias("gap")).distinct()


_POST = ("word", "id", "line", "n", "left", "b0", "b1")
#: Rows of lists that are joined at a time, and pairs that are looked at in one step.
LISTS, STEP = 50_000, 1 << 18


def _paired(posts: list[np.ndarray], percent: int):
    """The pairs within the lists of some words that pass the filters: arrays aid, aline, bid, bline, gap."""
    word, id_, line, n, left, b0, b1 = posts
    # By word, then size: the partners of a row that are at least as large follow it.
    key = (word.view(np.uint32).astype(np.int64) << 31) | n
    order = np.argsort(key)
    key, id_, line, n, left = key[order], id_[order], line[order], n[order].astype(np.int64), left[order].astype(np.int64)
    b0, b1 = b0[order].view(_U), b1[order].view(_U)  # bits of signed numbers would be counted without their sign
    most = np.minimum(n * 100 // percent, (100 + percent) * left // percent - n)
    ends = np.searchsorted(key, key - n + most, side="right")
    first = np.arange(1, len(key) + 1)
    counts = np.maximum(ends - first, 0)
    total = np.cumsum(counts)
    start = 0
    while start < len(key):
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + STEP, side="right")))
        some = counts[start:end]
        i = np.repeat(np.arange(start, end), some)
        j = np.arange(len(i)) - np.repeat(total[start:end] - some - done, some) + i + 1
        size = n[i] + n[j]
        keep = np.flatnonzero((100 + percent) * np.minimum(left[i], left[j]) >= percent * size)
        i, j, size = i[keep], j[keep], size[keep]
        gap = np.bitwise_count(b0[i] ^ b0[j]).astype(np.int64) + np.bitwise_count(b1[i] ^ b1[j])
        keep = np.flatnonzero((100 + percent) * (size - gap) >= 2 * percent * size)
        i, j, score = i[keep], j[keep], 1000 * gap[keep] // size[keep]
        later = (id_[i] > id_[j]) | ((id_[i] == id_[j]) & (line[i] > line[j]))
        a, b = np.where(later, i, j), np.where(later, j, i)
        differ = np.flatnonzero((id_[a] != id_[b]) | (line[a] != line[b]))
        a, b, score = a[differ], b[differ], score[differ]
        yield id_[a], line[a], id_[b], line[b], score
        start = end


def _cold_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """(aid, aline, bid, bline, gap) as by ``_pairs`` of posts with themselves, for words whose lists are short."""

    def run(batches):
        kept, size = [], 0

        def joined(last: bool):
            nonlocal kept, size
            columns = [np.concatenate(c) for c in zip(*kept)]
            # The list of the last word may go on.
            cut = size if last else size - int(np.argmax(np.append(columns[0][::-1] != columns[0][-1], True)))
            for found in _paired([c[:cut] for c in columns], percent) if cut else ():
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(found, (np.int64, np.int32, np.int64, np.int32, np.int64))], names=["aid", "aline", "bid", "bline", "gap"])
            kept, size = [[c[cut:] for c in columns]], size - cut

        for batch in batches:
            kept.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size >= LISTS:
                yield from joined(False)
        if size:
            yield from joined(True)
        release()

    dealt_out = posts.select(*_POST).repartition("word").sortWithinPartitions("word")
    return dealt_out.mapInArrow(run, "aid long, aline int, bid long, bline int, gap long").distinct()


def repeated_lines(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, line) of every line to remove, of (id, text): those with an earlier match."""
    from pyspark.sql import Window

    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    docs = docs.where(F.col("id").isNotNull())
    table = spark.sparkContext.broadcast(rarity(docs))  # 4 MB
    rows = scratch.table(_line_rows(docs, table, percent, min_words), "rows")
    first = F.min(F.struct("id", "line")).alias("first")
    whole = [F.min(c).alias(c) for c in ("n", "b0", "b1", "words", "left", "hot")]
    classes = scratch.table(rows.groupBy("class").agg(first, F.count(F.lit(1)).alias("m"), *whole), "classes")

    each = classes.select("first.id", "first.line", "n", "b0", "b1", F.explode(F.arrays_zip("words", "left", "hot")).alias("w"))
    posts = each.select(F.col("w.words").alias("word"), "id", "line", "n", F.col("w.left").alias("left"), "b0", "b1", F.col("w.hot").alias("hot"))
    pairs = scratch.table(_cold_pairs(posts.where("NOT hot"), percent), "cold")
    found = _verified(docs, pairs, percent, scratch, "cold")

    hot = scratch.table(posts.where("hot").drop("hot"), "hot")
    earliest = Window.partitionBy("word").orderBy("id", "line")
    pivots = scratch.table(hot.withColumn("r", F.row_number().over(earliest)).where(F.col("r") <= PIVOTS).drop("r"), "pivots")

    def still_open(posts: DataFrame, found: DataFrame) -> DataFrame:
        few = found.count() <= BROADCAST_IDS
        return posts.join(F.broadcast(found) if few else found.hint("merge"), ["id", "line"], "left_anti")

    pairs = scratch.table(_pairs(still_open(hot, found), pivots, percent), "pivot")
    near = scratch.table(found.union(_verified(docs, pairs, percent, scratch, "pivot")).distinct(), "near")
    # What is left meets the whole list; long lists are dealt out in blocks.
    counts = scratch.table(hot.groupBy("word").agg(F.count(F.lit(1)).alias("m")), "counts")
    counted = scratch.table(join_by_key(hot, counts, "word", "m", hot.count()), "counted")
    one, other = dealt(counted, "m", ["id", "line"])
    pairs = scratch.table(_pairs(still_open(one, near), other, percent, ("word", "__piece")), "rest")
    if pairs.limit(1).count():
        near = scratch.table(near.union(_verified(docs, pairs, percent, scratch, "rest")).distinct(), "nearest")
    scratch.drop("cold", "hot", "counts", "counted", "pivots", "pivot", "rest")

    gone = near.select(F.col("id").alias("fid"), F.col("line").alias("fline"), F.lit(True).alias("gone"))
    told = classes.select("class", F.col("first.id").alias("fid"), F.col("first.line").alias("fline"), "m")
    told = told.join(gone.hint("merge"), ["fid", "fline"], "left").where("m > 1 OR gone")
    told = scratch.table(told, "told")
    total = told.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    every = join_by_key(rows.select("class", "id", "line"), told, "class", "m", total)
    return every.where("gone OR id <> fid OR line <> fline").select("id", "line").distinct()


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS
) -> DataFrame:
    """All columns of df, with the text short of its repeated lines, and n_lines and n_removed.

    Lines end at line feeds. A line with fewer than ``min_words`` distinct words (blank
    lines always) neither goes nor makes another go. Lines are compared with all
    earlier lines, also those that go themselves, so the result does not depend on an
    order of work; of equal lines the one with the smallest (id, line number) stays.

    A null text stays null and has no lines; an empty one has one blank line. Rows
    with a null id come back as they are. Ids are meant to be unique: rows that share
    one lose the same line numbers, and a line that only one of them has counts for
    all. Columns ``n_lines`` and ``n_removed`` of df, if there are any, are replaced;
    others stay, whatever their names. An empty table gives an empty result. A very
    long text takes about 100 bytes of a worker's memory for each of its words.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scratch = Scratch(df.sparkSession, "cuts")
    rest = df.drop("n_lines", "n_removed")
    at, cuts, own = fresh(rest, "__id"), fresh(rest, "__cuts"), fresh(rest, "__new")
    gone = repeated_lines(docs, percent, min_words)
    # A bit for each line that goes, 64 to a number.
    words = gone.groupBy("id", F.expr("line DIV 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, line % 64)")).alias("b"), F.count(F.lit(1)).alias("n"))
    held = words.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"), F.max("w").alias("top"), F.sum("n").alias("n"))
    held = scratch.table(held.select("id", F.expr("transform(sequence(0L, top), w -> coalesce(m[w], 0L))").alias("bits"), "n"), "gone")
    few = held.agg(F.coalesce(F.sum(F.size("bits")), F.lit(0))).first()[0] <= BROADCAST_IDS
    held = held.select(F.col("id").alias(at), F.col("bits").alias(cuts))
    joined = rest.join(F.broadcast(held) if few else held.hint("merge"), F.col(id_col) == F.col(at), "left").drop(at)
    lines, hit = F.split(F.col(text_col), "\n", -1), F.col(cuts).isNotNull() & F.col(text_col).isNotNull()
    stays = lambda _, i: F.getbit(F.coalesce(F.get(F.col(cuts), F.floor(i / 64).cast("int")), F.lit(0).cast("long")), i % 64) == 0
    kept = F.when(hit, F.filter(lines, stays))
    n = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1)
    out = joined.select("*", n.cast("long").alias("n_lines"), kept.alias(own))
    new = F.when(F.col(own).isNull(), F.col(text_col)).otherwise(F.array_join(own, "\n"))
    removed = F.when(F.col(own).isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines") - F.size(own))
    return out.select(*[new.alias(c) if c == text_col else F.col(c) for c in rest.columns], "n_lines", removed.alias("n_removed"))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier line matches."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")
