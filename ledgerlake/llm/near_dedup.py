"""Near-duplicate documents by MinHash: fast similarity sketching, banding, exact verification.

*Sketch.* Each document is the set of its shingles. A round hashes every shingle to
a bin and a value; the first round that hits a bin fills it, with the smallest value
that the round puts there. Rounds go on until every bin is filled; from round T on
each round serves one bin, so after 2 T rounds none is empty (Dahlgaard, Knudsen and
Thorup, 2017). Two sketches agree in a bin with the probability of the sets'
similarity, as concentrated as with independent hashes, in time O(n + T log T).

*Banding.* BANDS keys of ROWS bins each; documents that share a key are candidates.
At a similarity of 0.8 a pair is missed with probability (1 - 0.8^6)^40 < 6e-6.

*Verification.* Links count only if they hold on the full sets.

Copies do not make pairs. Documents with equal sets are one class from the start.
Within a key, every class is first compared with the smallest one only; links make
components, and only pairs of different components that share a key are compared
then. So each link between different sets that shares a key is found or already
implied, and a group of m copies costs about m comparisons. No group is gathered
in one task: keys, classes and nodes that hold many rows are joined apart, and a
large key's last pairs are dealt out block by block (``common.dealt``).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import Scratch, dealt, join_by_key, release, slices
from ledgerlake.llm.components import components

BANDS, ROWS = 40, 6
T = BANDS * ROWS

_U = np.uint64
_ODD = (np.arange(1, 65, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixing permutation of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Words over so many bytes are hashed one by one.
LONG_WORD = 256

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks of the lowest 0 to 8 bytes of a 64-bit number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=_U)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch of texts, and where each text's words start (one more at the end).

    A-Z are lower-cased; words are what ASCII white space separates. Eight bytes of
    all words are mixed in at a time, so the work is done on arrays throughout.
    """
    import xxhash

    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    first, n = int(bounds[0]), int(bounds[-1] - bounds[0])
    if not n:
        return np.zeros(0, _U), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.zeros(n + 8, dtype=np.uint8)
    data[:n] = _LOWER[np.frombuffer(texts.buffers()[2], dtype=np.uint8, count=n, offset=first)]
    bounds = bounds - first
    space = _SPACE[data[:n]]
    begins = ~space
    begins[1:] &= space[:-1]
    ends = ~space
    ends[:-1] &= space[1:]
    edges = bounds[(bounds > 0) & (bounds < n)]  # a text's end is a word's end too
    begins[edges] = ~space[edges]
    ends[edges - 1] = ~space[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size = end - start
    eight = np.ndarray(n + 1, dtype="<u8", buffer=data.data, strides=(1,))
    hashes = mix(size.astype(_U) ^ (eight[start] & _LOW[np.minimum(size, 8)]) * _ODD[0])
    at, left = np.flatnonzero(size > 8), 8
    while len(at):
        if left >= LONG_WORD:
            for i in at.tolist():
                hashes[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
            break
        rest = size[at] - left
        hashes[at] = mix((hashes[at] ^ (eight[start[at] + left] & _LOW[np.minimum(rest, 8)])) * _ODD[1])
        at, left = at[rest > 8], left + 8
    return hashes, np.searchsorted(start, bounds)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct shingles of k words as sorted 64-bit hashes; with fewer words the whole sequence as one."""
    n = len(words)
    if not n:
        return words
    if n < k:
        return mix((words * _ODD[:n]).sum(keepdims=True) + _U(n))
    total = words[: n - k + 1] * _ODD[0]
    for i in range(1, k):
        total = total + words[i : n - k + 1 + i] * _ODD[i]
    return np.unique(mix(total))


def sketch(x: np.ndarray, t: int = T) -> np.ndarray:
    """The t bins of a set of hashes that is not empty: round and value of each bin's first hit."""
    bins = np.full(t, np.iinfo(_U).max, dtype=_U)
    first, rounds = 0, max(1, math.ceil(t * (math.log(t) + 2) / len(x)))
    while first < t:
        rounds = min(rounds, t - first, max(1, (1 << 16) // len(x)) or 1)
        seeds = mix(np.arange(first + 1, first + rounds + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
        h = mix(x[None, :] ^ seeds[:, None])
        place = ((h >> _U(32)) * _U(t)) >> _U(32)
        value = (np.arange(first, first + rounds, dtype=_U)[:, None] << _U(32)) | (h & _U(0xFFFFFFFF))
        np.minimum.at(bins, place.ravel().astype(np.intp), value.ravel())
        first += rounds
        # Bins hit in a later round keep their larger values: earlier rounds came first.
        if (bins < np.iinfo(_U).max).all():
            return bins
        rounds = max(1, math.ceil(t / len(x)))
    for i in np.flatnonzero(bins == np.iinfo(_U).max):
        h = mix(x ^ mix(np.array([t + i + 1], dtype=_U) * _U(0x9E3779B97F4A7C15)))
        bins[i] = (_U(t + i) << _U(32)) | (h & _U(0xFFFFFFFF)).min()
    return bins


def band_keys(bins: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; keys of different bands differ."""
    rows = bins.reshape(-1, ROWS)
    total = (rows * _ODD[:ROWS]).sum(axis=1) + np.arange(1, len(rows) + 1, dtype=_U) * _U(0xD6E8FEB86659FD93)
    return mix(mix(total)).astype(np.int64)


#: Longs of a set's parity bits.
PARITY = 8


def parity_bits(x: np.ndarray) -> np.ndarray:
    """64 * PARITY bits: each tells whether an odd number of the set's hashes falls on it.

    Two sets differ in at least as many elements as these bits differ.
    """
    odd = np.bincount((x & _U(64 * PARITY - 1)).astype(np.intp), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _per_document(df: DataFrame, schema: str, fields: list, make) -> DataFrame:
    """mapInArrow over (id, text): make(words of one text) gives the values of ``fields`` after the id."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1)):
            hashes, offsets = word_hashes(batch.column(1))
            rows = [make(hashes[offsets[i] : offsets[i + 1]]) for i in range(batch.num_rows)]
            arrays = [pa.array([r[j] for r in rows], kind) for j, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", *[n for n, _ in fields]])
        release()

    return df.mapInArrow(run, f"id long, {schema}")


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(id, n_shingles, class, bands, parity) of (id, text): class identifies the set, null where it is empty."""

    def make(words):
        import xxhash

        x = shingles(words, k)
        if not len(x):
            return 0, None, None, None
        return len(x), xxhash.xxh3_128_digest(x.tobytes()), band_keys(sketch(x)), parity_bits(x)

    fields = [("n_shingles", pa.int64()), ("class", pa.binary()), ("bands", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))]
    return _per_document(docs, "n_shingles long, class binary, bands array<long>, parity array<long>", fields, make)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, set) of (id, text): the sorted shingle hashes, eight bytes each."""
    return _per_document(docs, "set binary", [("set", pa.binary())], lambda words: (shingles(words, k).tobytes(),))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    joined = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 2)):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, dtype=_U), np.frombuffer(y, dtype=_U)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], names=["a", "b"])
        release()

    return joined.mapInArrow(run, "a long, b long")


#: Up to so many ids (8 bytes each) a list of ids is broadcast to pick rows; a longer one is joined by a shuffle.
BROADCAST_IDS = 1_000_000


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row.

    component_id is the smallest id that can be reached over links, the row's own
    included; kept says whether it is the row's own. Linked are documents whose
    sets of ``words``-word shingles have 100 * intersection >= percent * union.

    A null or empty text, or one of white space alone, has no shingles and is linked
    with nothing. Rows with a null id cannot be linked: their component is null and
    they are kept. Rows that share an id and text are copies of each other and have
    one component. Ids are meant to be unique: where an id has several texts and is
    the smallest of more than one class of copies, its links are confirmed on the
    smallest of its sets. Other columns are dropped; an empty table gives an empty
    result. Ties do not arise: the smallest id stands for its group. A very long text
    takes about 50 bytes of a worker's memory for each of its words.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "near")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = scratch.table(sketches(docs, words), "rows")
    usable = rows.where(F.col("class").isNotNull() & F.col("id").isNotNull())

    # One document of each class stands for it. Its bands are those of any member.
    classes = usable.groupBy("class").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("n_shingles").alias("size"), F.min("bands").alias("bands"), F.min("parity").alias("parity"))
    classes = scratch.table(classes, "classes")
    keyed = classes.select("class", F.col("rep"), "size", F.explode("bands").alias("key"))
    keys = keyed.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("m")).where("m > 1")
    keys = scratch.table(keys, "keys")
    shared = keys.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    posts = scratch.table(join_by_key(keyed.select("key", "rep", "size"), keys, "key", "m", shared), "posts")
    scratch.drop("keys")

    def sets_of(pairs: DataFrame, name: str) -> DataFrame:
        """The full sets of all documents that stand in pairs."""
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        ids = scratch.table(ids, f"{name}-ids")
        few = ids.count() <= BROADCAST_IDS
        picked = docs.join(F.broadcast(ids) if few else ids.hint("merge"), "id", "left_semi")
        sets = scratch.table(shingle_sets(picked, words), f"{name}-sets")
        # Copies of a row, and ids with several texts, would make pairs several times.
        return sets if sets.count() == ids.count() else sets.groupBy("id").agg(F.min("set").alias("set"))

    pairs = posts.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = scratch.table(pairs, "pairs1")
    # First each class with its smallest pivot; most of the other pairs are implied by then.
    nearest = pairs.groupBy("a").agg(F.min("b").alias("b"))
    sets = sets_of(pairs, "first")
    links = scratch.table(verify(nearest, sets, percent), "links1")
    found = scratch.table(components(links, scratch, "c1"), "found1")

    def labelled(pairs: DataFrame, found: DataFrame) -> DataFrame:
        """Pairs whose ends lie in different components."""
        a, b = found.select(F.col("node").alias("a"), F.col("component").alias("ca")), found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        out = pairs.join(a.hint("merge"), "a", "left").join(b.hint("merge"), "b", "left")
        return out.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    scratch.drop("first-ids")
    open_ = labelled(pairs.join(nearest.hint("merge"), ["a", "b"], "left_anti"), found)
    more = scratch.table(verify(open_, sets, percent), "links2")
    scratch.drop("first-sets", "pairs1")
    links = links.unionByName(more)
    found = scratch.table(components(links, scratch, "c2"), "found2")

    # What is left: pairs of different components that share a key, neither of them its pivot.
    member = posts.where("rep <> pivot").join(
        found.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left"
    ).select("key", "rep", "size", F.coalesce("component", "rep").alias("c"))
    mixed = member.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("m")).where("low <> high")
    member = scratch.table(join_by_key_counted(member, mixed.select("key", "m"), scratch), "member")
    # Neighbours of a large group share many keys without being similar enough: the join itself drops
    # pairs whose sizes or parity bits rule a link out, before they become rows.
    signed = member.join(classes.select("rep", *[F.col("parity")[i].alias(f"s{i}") for i in range(PARITY)]).hint("merge"), "rep")
    signed = scratch.table(signed, "signed")
    scratch.drop("posts", "mixed", "member")
    differ = " + ".join(f"bit_count(x.s{i} ^ y.s{i})" for i in range(PARITY))
    fits = (
        f"x.rep > y.rep AND x.c <> y.c AND 100 * least(x.size, y.size) >= {percent} * greatest(x.size, y.size)"
        f" AND {100 + percent} * (x.size + y.size - ({differ})) >= {2 * percent} * (x.size + y.size)"
    )
    one, other = dealt(signed, "m", ["rep"])
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.__piece") == F.col("y.__piece"))
    rest = one.alias("x").hint("merge").join(other.alias("y"), same & F.expr(fits))
    rest = rest.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    rest = scratch.table(rest.select("a", "b").distinct(), "pairs3")
    scratch.drop("signed")
    if rest.limit(1).count():
        more = scratch.table(verify(rest, sets_of(rest, "rest"), percent), "links3")
        found = scratch.table(components(links.unionByName(more), scratch, "c3"), "found3")

    named = classes.join(found.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left")
    named = scratch.table(named.select("class", "n", F.coalesce("component", "rep").alias("component_id")), "named")
    scratch.drop("classes", "found1", "found2", "found3", "links1", "links2", "links3", "pairs3", "rest-ids", "rest-sets")
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    told = join_by_key(usable.select("id", "n_shingles", "class"), named, "class", "n", total).select("id", "n_shingles", "component_id")
    alone = rows.where(F.col("class").isNull() | F.col("id").isNull()).select("id", "n_shingles", F.col("id").alias("component_id"))
    out = told.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def join_by_key_counted(rows: DataFrame, keys: DataFrame, scratch: Scratch) -> DataFrame:
    keys = scratch.table(keys, "mixed")
    total = keys.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    return join_by_key(rows, keys, "key", "m", total)


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Components of near copies among all documents, on shingles of four words."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
