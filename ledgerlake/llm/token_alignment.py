"""Alignment of the tokens of two tokenizers, and how often their ids meet in a corpus.

Both tokenizers cut the same bytes. Each side gives the cumulative ends of its tokens; a
dictionary leads from an end to the number of tokens up to it. The ends that both
dictionaries hold (an intersection of hash sets), sorted, slice both id lists into
groups: the smallest runs of tokens that cover the same bytes. Within a group a token of
one side is linked with each token of the other whose bytes it overlaps.

Neither tokenizer looks over a single space between two other characters: one starts a
token with it, the other starts a chunk there (no piece of it holds a space mark after
another character, asserted when it is loaded). So texts are cut at such spaces into
words, words are aligned alone, and those that come again are looked up in tables of
bounded size.

Counts of id pairs over the corpus: a task gathers the distinct pairs of some megabytes
of documents (a lot) before anything is shuffled, the lots' counts are summed up by pair,
and each lot gets the totals of its pairs back, beside its documents. A pair is in a lot
once, however often it occurs, so no pair is a hot key, and nothing is broadcast.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import Memo, Scratch, release, slices, spelling

BYTE_MODEL, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of text whose distinct pairs are gathered before the shuffle (one document at least).
LOT_BYTES = 8 << 20
#: A longer text is worked on in parts of about so many characters, a longer word is not kept in a table.
PART, KEPT = 1 << 20, 64
#: Words of one generation of a worker's table.
WORDS = 300_000
#: A pair of ids as one number.
SHIFT = 32

_CUT = re.compile(r"(?<=\S)\x20(?=\S)")


def groups(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """(tokens of A, tokens of B) up to each end that both sides have, in order."""
    at_a, at_b = dict(zip(ends_a, range(1, len(ends_a) + 1))), dict(zip(ends_b, range(1, len(ends_b) + 1)))
    return [(at_a[end], at_b[end]) for end in sorted(at_a.keys() & at_b.keys())]


def links(ends_a: list[int], ends_b: list[int], a: int, b: int, to_a: int, to_b: int) -> list[tuple[int, int]]:
    """Pairs of tokens that overlap within one group, the tokens a..to_a and b..to_b."""
    out = []
    while a < to_a and b < to_b:
        out.append((a, b))
        end_a, end_b = ends_a[a], ends_b[b]
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
    return out


#: Words of these characters are cut by a plain pattern.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: How the byte-level tokenizer cuts a space and a word of these characters.
_PARTS = re.compile("'(?:[sdmt]|ll|ve|re)|\x20?[A-Za-zÀ-ÖØ-öø-ÿ]+|\x20?[0-9]+|\x20?[^\x20A-Za-zÀ-ÖØ-öø-ÿ0-9]+")


class Aligner:
    """Both tokenizers, and the alignments of words by look-up."""

    def __init__(self, byte_model: str, piece_model: str):
        import sentencepiece
        import tokenizers

        library = tokenizers.Tokenizer.from_file(byte_model)
        self.model, self.cut = library.model, library.pre_tokenizer.pre_tokenize_str  # added tokens are not looked for: their strings are plain text
        self.spelled = spelling()
        alphabet = {c: b for b, c in enumerate(self.spelled)}
        self.bytes_a = {i: bytes([alphabet[c] for c in piece]) if all(c in alphabet for c in piece) else piece.encode() for piece, i in library.get_vocab().items()}
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        n = self.pieces.get_piece_size()
        names = [self.pieces.id_to_piece(i) for i in range(n)]
        if any(SPACE in name.lstrip(SPACE) for name in names):
            raise ValueError("a piece of this model reaches over a space mark; words could not be aligned alone")
        self.bytes_b = [bytes([int(name[3:5], 16)]) if self.pieces.is_byte(i) else name.replace(SPACE, " ").encode() for i, name in enumerate(names)]
        self.part = Memo(lambda part: [t.id for t in self.model.tokenize(part)], 1 << 17)
        self.plain = Memo(lambda part: self.part["".join([self.spelled[b] for b in part.encode()])], 1 << 18)
        #: Two generations of words: the young one is that of the words met lately, long ones last for one slice.
        self.young, self.old, self.long = {}, {}, {}

    def ids_a(self, text: str) -> list[int]:
        """The ids of space + text."""
        if len(text) > KEPT:
            return [t.id for part, _ in self.cut(" " + text) for t in self.model.tokenize(part)]
        if _PLAIN.fullmatch(text):
            parts = _PARTS.findall(" " + text)
            return self.plain[parts[0]] if len(parts) == 1 else [i for part in parts for i in self.plain[part]]
        return [i for part, _ in self.cut(" " + text) for i in self.part[part]]

    def aligned(self, text: str, a: list[int], b: list[int]) -> tuple[int, int, int, str, bytes, bool]:
        """(tokens of A, of B, groups, the groups as text, pairs as int64, whether both sides give the bytes of space + text)."""
        side_a, side_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        whole = (" " + text).encode()
        if b"".join(side_a) != whole or b"".join(side_b) != whole:
            return 0, 0, 0, "", b"", False
        ends_a, ends_b = list(accumulate(map(len, side_a))), list(accumulate(map(len, side_b)))
        told, pairs, i, j = [], [], 0, 0
        for to_i, to_j in groups(ends_a, ends_b):
            if to_i - i == 1 == to_j - j:
                told.append(f"{a[i]}|{b[j]}")
                pairs.append(a[i] << SHIFT | b[j])
            else:
                told.append(",".join(map(str, a[i:to_i])) + "|" + ",".join(map(str, b[j:to_j])))
                pairs += [a[x] << SHIFT | b[y] for x, y in links(ends_a, ends_b, i, j, to_i, to_j)]
            i, j = to_i, to_j
        return len(a), len(b), len(told), ";".join(told), array("q", pairs).tobytes(), True

    def learn(self, words: set[str]) -> None:
        """Have the alignments of these words at hand; new ones are encoded together."""
        if len(self.young) > WORDS:
            self.old, self.young = self.young, {}
        self.long = {}
        new, young, old = [], self.young, self.old
        for word in words:
            if word not in young:
                known = old.get(word)
                if known is None:
                    new.append(word)
                else:
                    young[word] = known
        for word, b in zip(new, self.pieces.encode(new, num_threads=1)):
            (young if len(word) <= KEPT else self.long)[word] = self.aligned(word, self.ids_a(word), b)

    def known(self, words: list[str]) -> list[tuple]:
        young, long = self.young, self.long
        return [young.get(w) or long[w] for w in words] if long else list(map(young.__getitem__, words))

    def documents(self, texts: list[str | None]) -> list[tuple]:
        """(tokens of A, of B, groups, digest of the groups, distinct pairs, their numbers) of each text."""
        cut = {i: _CUT.split(text) for i, text in enumerate(texts) if text and len(text) <= PART}
        self.learn({word for words in cut.values() for word in words})
        # Short texts first: their words are at hand now.
        out = {i: self._told([self.known(words)]) for i, words in cut.items()}
        for i, text in enumerate(texts):
            if i not in out:
                out[i] = self._told(self._in_parts(text or ""))
        return [out[i] for i in range(len(texts))]

    def _in_parts(self, text: str) -> Iterator[list[tuple]]:
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + PART)  # looks at the characters beside the space; the next part starts after it
            end = cut.start() if cut else len(text)
            words = _CUT.split(text[at:end])
            self.learn(set(words))
            yield self.known(words)
            at = end + 1

    @staticmethod
    def _told(parts: Iterable[list[tuple]]) -> tuple:
        total, digest, found = np.zeros(3, dtype=np.int64), hashlib.sha256(), []
        for words in parts:
            a, b, n, told, pairs, same = zip(*words)
            if not all(same):
                # Bytes are compared word by word: what one word lacks no other can make up for.
                return _NONE
            digest.update(((";" if found else "") + ";".join(told)).encode())
            total += (sum(a), sum(b), sum(n))
            found.append(np.unique(np.frombuffer(b"".join(pairs), dtype=np.int64), return_counts=True))
        if not found:
            return _NONE
        if len(found) == 1:
            return *total.tolist(), digest.hexdigest(), *found[0]
        pairs, place = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([n for _, n in found]), len(pairs)).astype(np.int64)
        return *total.tolist(), digest.hexdigest(), pairs, counts


_NONE = 0, 0, 0, "", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)


@lru_cache(maxsize=2)
def _aligner(byte_model: str, piece_model: str) -> Aligner:
    """One for each Python worker."""
    return Aligner(byte_model, piece_model)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *arrays]), kind))


_LOT = "lot long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, steps array<int>, counts array<int>, pairs array<long>, totals array<long>"
_KINDS = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_model: str | None = None, piece_model: str | None = None) -> DataFrame:
    """(id, a_ids, b_ids, a_ends, b_ends): both id lists of each text and where the groups end in them.

    Group k holds a_ids[a_ends[k-1]:a_ends[k]] and b_ids[b_ends[k-1]:b_ends[k]]. Texts
    without tokens (see align) have empty lists. Other columns are dropped.
    """
    paths = byte_model or public_tokenizers.path(BYTE_MODEL), piece_model or public_tokenizers.path(PIECE_MODEL)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def whole(aligner: Aligner, text: str | None) -> list[list[int]]:
        ids_a, ids_b, ends = [], [], []
        for word in _CUT.split(text) if text else []:
            a, b = aligner.ids_a(word), aligner.pieces.encode(word)
            if not aligner.aligned(word, a, b)[5]:
                return [[], [], [], []]
            sides = list(accumulate(len(aligner.bytes_a[i]) for i in a)), list(accumulate(len(aligner.bytes_b[i]) for i in b))
            ends += [(len(ids_a) + x, len(ids_b) + y) for x, y in groups(*sides)]
            ids_a += a
            ids_b += b
        return [ids_a, ids_b, [x for x, _ in ends], [y for _, y in ends]]

    def run(batches):
        aligner = _aligner(*paths)
        for batch in (part for all_rows in batches for part in slices(all_rows, 1)):
            out = [whole(aligner, text) for text in batch.column(1).to_pylist()]
            arrays = [pa.array([o[k] for o in out], pa.list_(pa.int32())) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])
        release()

    out = rows.mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")
    return out.withColumnRenamed("doc_id", id_col)


def _lots(docs: DataFrame, id_col: str, text_col: str, byte_model: str, piece_model: str, lot_bytes: int, scratch: Scratch) -> DataFrame:
    """Rows of two kinds, by ``lot``: one for each document (its pairs as places in the lot's list, as steps), and one for the lot (pairs, totals)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("part"))

    def told(lot: int, ids: list, done: list[tuple]) -> list[pa.RecordBatch]:
        pairs, place = np.unique(np.concatenate([d[4] for d in done]), return_inverse=True)
        counts = np.concatenate([d[5] for d in done])
        ends = np.cumsum([0, *(len(d[4]) for d in done)])
        steps = [np.diff(place[a:b], prepend=0) for a, b in zip(ends, ends[1:])]
        n, null = len(done), pa.nulls
        docs_ = [pa.array([lot] * n), pa.array(ids, pa.int64()), *(pa.array([d[k] for d in done], pa.int64()) for k in range(3)), pa.array([d[3] for d in done]),
                 _lists(steps, pa.int32()), _lists([d[5] for d in done], pa.int32()), null(n, _KINDS[8]), null(n, _KINDS[9])]
        totals = np.bincount(place, counts, len(pairs)).astype(np.int64)
        lot_ = [pa.array([lot]), *(null(1, k) for k in _KINDS[1:8]), _lists([pairs], pa.int64()), _lists([totals], pa.int64())]
        names = [x.split()[0] for x in _LOT.split(", ")]
        return [pa.RecordBatch.from_arrays(x, names=names) for x in (docs_, lot_)]

    def run(batches):
        aligner, ids, done, size, lot = _aligner(byte_model, piece_model), [], [], 0, 0
        part = 0
        for batch in (part_ for whole in batches for part_ in slices(whole, 1)):
            part = batch.column(2)[0].as_py()
            texts = batch.column(1).to_pylist()
            for doc, text, told_ in zip(batch.column(0).to_pylist(), texts, aligner.documents(texts)):
                ids.append(doc)
                done.append(told_)
                size += len(text or "")
                if size >= lot_bytes:
                    yield from told(part << 32 | lot, ids, done)
                    ids, done, size, lot = [], [], 0, lot + 1
        if done:
            yield from told(part << 32 | lot, ids, done)
        release()

    return scratch.table(rows.mapInArrow(run, _LOT), "lots")


def pair_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_model: str | None = None, piece_model: str | None = None, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """(a_id, b_id, n, best): how many links of the corpus hold each pair of ids, and whether no pair with this b_id has more."""
    paths = byte_model or public_tokenizers.path(BYTE_MODEL), piece_model or public_tokenizers.path(PIECE_MODEL)
    lots = _lots(docs, id_col, text_col, *paths, lot_bytes, Scratch(docs.sparkSession, "pairs"))
    a, b = F.shiftright("pair", SHIFT).cast("int"), F.col("pair").bitwiseAND((1 << SHIFT) - 1).cast("int")
    return _totals(lots).select(a.alias("a_id"), b.alias("b_id"), "n", "best")


def _per_lot(lots: DataFrame) -> DataFrame:
    each = lots.where("pairs IS NOT NULL").select("lot", F.explode(F.arrays_zip("pairs", "totals")).alias("x"))
    return each.select("lot", F.col("x.pairs").alias("pair"), F.col("x.totals").alias("n"))


def _totals(lots: DataFrame) -> DataFrame:
    """(pair, n, best). Pairs of one id of B are at most as many as A has ids; their largest count is found by a sum before the shuffle."""
    totals = _per_lot(lots).groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND((1 << SHIFT) - 1))
    most = totals.groupBy("b").agg(F.max("n").alias("most"))
    return totals.join(most.hint("merge"), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_model: str | None = None, piece_model: str | None = None, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row.

    A: space + text by a byte-level BPE; B: text by a piece model, which adds the space.
    Texts that are null or empty, or whose tokens of one side do not give the bytes of
    space + text again, have no tokens: zeros and an empty digest. n_best: links whose
    pair is the most frequent of the corpus with its id of B, ties included; count_sum:
    the corpus counts of the pairs of all links. Each row gives one row and counts in the
    corpus, equal rows and rows with a null id too; other columns are dropped, whatever
    their names. An empty table gives an empty result. A text is cut at single spaces; one
    very long word takes about 500 bytes of a worker's memory for each of its characters.
    """
    paths = byte_model or public_tokenizers.path(BYTE_MODEL), piece_model or public_tokenizers.path(PIECE_MODEL)
    scratch = Scratch(docs.sparkSession, "alignment")
    lots = _lots(docs, id_col, text_col, *paths, lot_bytes, scratch)
    totals = scratch.table(_totals(lots), "totals")
    # A lot has each of its pairs once, so no pair has more rows than there are lots.
    facts = _per_lot(lots).select(F.col("lot").alias("of_lot"), "pair").join(totals.hint("merge"), "pair")
    rows = lots.where("steps IS NOT NULL").select("lot", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "steps", "counts")

    def scored(mine: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("pair")
        n, best = known["n"].to_numpy(), known["best"].to_numpy()
        out = []
        for steps, counts in zip(mine["steps"], mine["counts"]):
            place, counts = np.cumsum(np.asarray(steps, dtype=np.int64)), np.asarray(counts, dtype=np.int64)
            out.append((int(counts.sum()), int(counts @ best[place]), int(counts @ n[place])))
        return mine[["doc_id", "n_a", "n_b", "n_groups"]].assign(
            n_links=[o[0] for o in out], n_best=[o[1] for o in out], count_sum=[o[2] for o in out], groups_sha256=mine["groups_sha256"]
        )

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("lot").cogroup(facts.groupBy("of_lot")).applyInPandas(scored, schema).withColumnRenamed("doc_id", id_col)


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    """How the tokens of two vocabularies line up in every document."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
