"""Substring dedup by sliding sentence spans.

A text is cut into sentences (after . ! or ? before white space, and at line feeds); a
sentence of more than LONG words counts as several. Its words say where it is cut:
after each word whose hash is the least among NEAR words on either side, and within
what is still longer than PART words after the least one there. So equal words are cut
alike wherever they stand, but for a few at both ends of a passage. From each sentence a span runs over the next ones until it holds MIN_SENTENCES of them and
MIN_WORDS words. All spans are hashed and counted over the whole corpus, and each
sentence that lies in a repeated span which is not its first occurrence goes. The first
occurrence is that of the smallest document id, and in it the first one.

Spans are counted with sums before the shuffle; hashes that hold a large share of all
spans are joined apart. Only hashes and positions are counted; the texts of documents
are joined once with the numbers of their sentences to go.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import Scratch, join_by_key, release, slices

MIN_SENTENCES, MIN_WORDS, LONG, PART, NEAR = 3, 15, 13, 12, 4

#: Where a sentence ends, with the white space that belongs to it. Each place is looked at once, also in runs of full stops.
_END = re.compile(r"[.!?](?=\s)[^\S\n]*\n?|\n")
_WORD = re.compile(r"\S+\s*")


def cuts(lists: list[tuple]) -> list[list[int]]:
    """For each list of words, the numbers of the words that begin a piece, other than the first."""
    from xxhash import xxh32_intdigest

    # All lists in one array, with NEAR largest values around each.
    ends = np.cumsum([len(words) + NEAR for words in lists])
    hashes = np.full(NEAR + int(ends[-1]), 1 << 32, dtype=np.int64)
    for end, words in zip(ends.tolist(), lists):
        hashes[end - len(words) : end] = list(map(xxh32_intdigest, words))
    n = len(hashes) - 2 * NEAR
    low = hashes[:n]
    for k in range(1, 2 * NEAR + 1):
        low = np.minimum(low, hashes[k : n + k])
    least = np.flatnonzero(hashes[NEAR : n + NEAR] == low) + NEAR + 1
    out = []
    for end, words in zip(ends.tolist(), lists):
        first = end - len(words)
        a, b = np.searchsorted(least, [first + 1, end])
        at = [0, *(least[a:b] - first).tolist(), len(words)]
        open_, found = [(x, y) for x, y in zip(at, at[1:]) if y - x > PART], at[1:-1]
        while open_:
            x, y = open_.pop()
            cut = x + 3 + int(np.argmin(hashes[first + x + 2 : first + y - 3]))
            found.append(cut)
            open_ += [(u, v) for u, v in ((x, cut), (cut, y)) if v - u > PART]
        out.append(sorted(found))
    return out


def sentences(text: str) -> list[tuple[int, int, tuple]]:
    """(start, end, words) of each sentence, in order; white space after one belongs to it."""
    out, long, end = [], [], 0
    for stop in [*(m.end() for m in _END.finditer(text)), len(text)]:
        if stop == end:
            continue
        start, end = end, stop
        words = tuple(text[start:end].lower().split())
        if not words:
            if out:  # a line feed goes with the sentence before it
                out[-1] = (out[-1][0], end, out[-1][2])
                continue
        if len(words) > LONG:
            long.append(len(out))
        out.append((start if out else 0, end, words))
    if not long:
        return out
    pieces, done = [], 0
    for k, at in zip(long, cuts([out[k][2] for k in long])):
        start, end, words = out[k]
        # From the first word on: white space at the front belongs to it.
        begins = [m.start() for m in _WORD.finditer(text, start, end)]
        places, numbers = [start, *(begins[i] for i in at), end], [0, *at, len(words)]
        pieces += out[done:k]
        pieces += [(places[i], places[i + 1], words[numbers[i] : numbers[i + 1]]) for i in range(len(numbers) - 1)]
        done = k + 1
    return pieces + out[done:]


def spans(parts: list[tuple]) -> list[tuple[int, int]]:
    """(first sentence, one beyond the last) of each span; sentences without words count for nothing."""
    out, n = [], len(parts)
    end = words = full = 0
    for start in range(n):
        end = max(end, start)
        while end < n and (full < MIN_SENTENCES or words < MIN_WORDS):
            words += len(parts[end][2])
            full += bool(parts[end][2])
            end += 1
        if full < MIN_SENTENCES or words < MIN_WORDS:
            break
        if parts[start][2]:
            out.append((start, end))
        words -= len(parts[start][2])
        full -= bool(parts[start][2])
    return out


def _span_rows(docs: DataFrame) -> DataFrame:
    """(span, id, first, last, again): again says that the same document has the span before.

    One more row of each text, without a span, has the number of its sentences as ``last``.
    """

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = sentences(text) if text else []
                hashed, seen = [digest("\t".join(p[2])) if p[2] else b"" for p in parts], set()
                for a, b in spans(parts):
                    key = digest(b"".join(hashed[a:b]))
                    rows.append((key, i, a, b, key in seen))
                    seen.add(key)
                rows.append((None, i, 0, len(parts), False))
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["span", "id", "first", "last", "again"])
        release()

    return docs.mapInArrow(run, "span binary, id long, first int, last int, again boolean")


def _cut(joined: DataFrame) -> DataFrame:
    """(row, n_sentences, n_removed, text) of (row, text, gone, n): the text without the sentences of its spans.

    A text that loses nothing and whose sentences were counted (n) is not cut again.
    """

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows = []
            for text, gone, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if not gone and n is not None:
                    rows.append((n, 0, text))
                    continue
                parts = sentences(text) if text else []
                out = np.zeros(len(parts), dtype=bool)
                for s in gone or []:
                    out[s["first"] : s["last"]] = True
                new = "".join([text[a:b] for (a, b, _), g in zip(parts, out) if not g]) if out.any() else text
                rows.append((len(parts), int(out.sum()), new))
            n, m, new = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(new, pa.string())],
                names=["id", "n_sentences", "n_removed", "text"],
            )
        release()

    return joined.mapInArrow(run, "id long, n_sentences long, n_removed long, text string")


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_sentences, n_removed, text) for each row; text is what stays.

    A null text stays null, an empty one empty; both have no sentences. Rows with a
    null id keep their text, and their spans count nowhere. Ids are meant to be
    unique: rows that share one count as one occurrence, and lose the same sentences.
    Other columns are dropped, whatever their names; an empty table gives an empty
    result. Of equal spans the one with the smallest (id, place) stays. A very long
    text takes about 300 bytes of a worker's memory for each of its words.
    """
    scratch = Scratch(df.sparkSession, "spans")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = scratch.table(_span_rows(docs.where(F.col("id").isNotNull())), "rows")
    counted = rows.where("span IS NOT NULL").groupBy("span").agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = scratch.table(counted, "counted")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    later = join_by_key(rows, counted, "span", "n", total).where("again OR id <> owner")
    told = later.select("id", F.struct("first", "last").alias("s"), F.lit(None).cast("int").alias("n"))
    sizes = rows.where("span IS NULL").select("id", F.lit(None).cast("struct<first:int,last:int>").alias("s"), F.col("last").alias("n"))
    # Rows that share an id may have different texts: their sentences are counted again.
    only = F.when(F.count("n") == 1, F.min("n"))
    gone = told.unionByName(sizes).groupBy("id").agg(F.collect_set("s").alias("gone"), only.alias("n"))
    gone = scratch.table(gone, "gone")
    scratch.drop("rows", "counted")
    joined = docs.join(gone.hint("merge"), "id", "left").select("id", "text", "gone", "n")
    out = _cut(joined)
    return out.select(F.col("id").alias(id_col), "n_sentences", "n_removed", F.col("text").alias(text_col))


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the sentences of spans that occurred before."""
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
