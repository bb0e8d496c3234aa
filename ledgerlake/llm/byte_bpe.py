"""Byte-level BPE encoding and decoding.

A text is split by the vocabulary's pattern, and each match (a pre-token) is
merged on its own: always the adjacent pair whose join has the lowest rank,
leftmost first. The next merge is found with a *hierarchical-bitmap rank queue*:
there is a bucket for each rank that holds the positions in the linked list of
parts where a pair of that rank starts, a bit for each bucket that is not empty,
and above these bits two levels that tell which words of bits are not zero. The
lowest set bit of each level leads to the next rank in three steps. A merge
changes the pairs on both sides; their old entries stay and are skipped when they
are met (stale).

All pre-tokens of a slice of texts stand in one linked list, with a gap between two
of them that no pair crosses. So one queue serves them all, and all positions of a
bucket are merged at once. That is exact: within a pre-token, merges come in order
of rank. Only where a merge makes a pair of a *lower* rank than its own (the
vocabulary tells for which ranks this can be) must that pair come first; then the
rest of the bucket waits in this pre-token. The steps of a slice are bounded by the
ranks that occur, not by the length of a pre-token, so that very long ones (base64,
one symbol repeated) cost no more than others.

Texts are read in tasks and never shuffled. Within a task a slice of about SLICE
bytes (or one text, if that is longer) is worked on at a time; the words of the
slice before it are remembered, and nothing beyond the task but the vocabulary.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import per_text, release, slices

VOCABULARY = "byte_bpe_50k.tiktoken"
SLICE = 3 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (base64 and a number on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Ranks of tokens and of the pairs that make them. Its size is that of the vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        #: The rank of each single byte.
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pair = {}
        lower = np.zeros(self.size, dtype=bool)
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    self.pair[left << 32 | right] = rank
                    for part in (left, right):
                        lower[part] |= part > rank
        #: Ranks whose merge may make a pair of a lower rank.
        self.lower = lower
        keys = np.array(sorted(self.pair), dtype=np.int64)
        self.keys, self.values = np.append(keys, np.iinfo(np.int64).max), np.array([*map(self.pair.get, keys.tolist()), -1])

    def look_up(self, left, right) -> np.ndarray:
        """The rank of the join of each pair of tokens; -1 where it is no token."""
        keys = left << 32 | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.values[at], -1)


class RankQueue:
    """Arrays of positions by rank; the lowest rank comes first.

    Bit r & 63 of low[r >> 6] tells that bucket r is not empty, bit a & 63 of
    mid[a >> 6] that low[a] is not zero, bit b of ``top`` that mid[b] is not zero.
    """

    def __init__(self, ranks: int):
        self.buckets: list[list] = [[] for _ in range(ranks)]
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, at: np.ndarray) -> None:
        bucket = self.buckets[rank]
        bucket.append(at)
        if len(bucket) == 1:
            a = rank >> 6
            word = self.low[a]
            self.low[a] = word | 1 << (rank & 63)
            if not word:
                b = a >> 6
                self.mid[b] |= 1 << (a & 63)
                self.top |= 1 << b

    def push_all(self, ranks: np.ndarray, at: np.ndarray) -> None:
        """Push positions into the buckets of their ranks; those of rank -1 have none."""
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        starts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]])).tolist() if len(ranks) else []
        for start, end in zip(starts, [*starts[1:], len(ranks)]):
            if (rank := int(ranks[start])) >= 0:
                self.push(rank, at[start:end])

    def pop(self) -> tuple[int, np.ndarray]:
        """The lowest rank and all its positions in order."""
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        bit = word & -word
        rank = a << 6 | bit.bit_length() - 1
        self.low[a] = word ^ bit
        if word == bit:
            self.mid[b] ^= 1 << (a & 63)
            if not self.mid[b]:
                self.top ^= 1 << b
        bucket, self.buckets[rank] = self.buckets[rank], []
        return rank, bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))


#: The token that stands in the gaps between pre-tokens; it makes no pair.
GAP = (1 << 31) - 1


def merge(pieces: list[bytes], vocabulary: Vocabulary, queue: RankQueue) -> list[bytes]:
    """Token ids of pre-tokens, four little-endian bytes each. The queue is empty before and after."""
    look_up, pair_of = vocabulary.look_up, vocabulary.pair.get
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths  # a gap comes first, and one after each pre-token
    n = 1 + int(lengths.sum()) + len(pieces)
    token = np.full(n, GAP, dtype=np.int64)
    inside = np.ones(n, dtype=bool)
    inside[0] = False
    inside[ends] = False
    token[inside] = vocabulary.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    #: The rank of the pair that starts at a position; -1 where there is none.
    pair = np.append(look_up(token[:-1], token[1:]), -1)
    queue.push_all(pair, np.arange(n))
    while queue.top:
        rank, at = queue.pop()
        at = at[pair[at] == rank]  # the others are stale: a merge beside them has changed or taken the pair
        if len(at) < 5 and not vocabulary.lower[rank]:
            for p in at.tolist():  # one by one, where arrays would cost more
                if pair[p] != rank:
                    continue  # shared a part with the one before
                gone = int(after[p])
                end, left = int(after[gone]), int(before[p])
                token[p], after[p], before[end], pair[gone], inside[gone] = rank, end, p, -1, False
                for q, key in ((p, rank << 32 | int(token[end])), (left, int(token[left]) << 32 | rank)):
                    new = pair[q] = pair_of(key, -1)
                    if new >= 0:
                        queue.push(new, np.array([q]))
            continue
        every = at
        if len(at) > 1:
            # Pairs that share a part: leftmost first, so every other one of a run.
            follows = np.append(False, at[1:] == after[at[:-1]])
            if follows.any():
                number = np.arange(len(at))
                at = at[(number - np.maximum.accumulate(np.where(follows, 0, number))) % 2 == 0]
        if not len(at):
            continue
        if vocabulary.lower[rank]:
            at = _until_lower(at, every, rank, token, after, before, starts, look_up, queue)
        gone = after[at]
        end = after[gone]
        token[at], after[at], before[end], pair[gone], inside[gone] = rank, end, at, -1, False
        left = before[at]
        to_right, to_left = look_up(rank, token[end]), look_up(token[left], rank)
        pair[at], pair[left] = to_right, to_left
        queue.push_all(np.concatenate([to_right, to_left]), np.concatenate([at, left]))
    counts = np.append(0, np.cumsum(inside))
    raw = token[inside].astype("<u4").tobytes()
    bounds = (4 * counts[ends]).tolist()
    return [raw[a:b] for a, b in zip([0, *bounds], bounds)]


def _until_lower(at, every, rank, token, after, before, starts, look_up, queue) -> np.ndarray:
    """Of the positions of a rank, in each pre-token those up to the first whose merge makes a pair of a lower rank.

    The rest goes back to the queue, which serves the lower rank first; so do positions of ``every``
    that share a part with one that waits.
    """
    right = look_up(rank, token[after[after[at]]])
    left = look_up(np.where(np.append(False, at[1:] == after[after[at[:-1]]]), rank, token[before[at]]), rank)
    lower = ((right >= 0) & (right < rank)) | ((left >= 0) & (left < rank))
    if not lower.any() or len(at) == 1:
        return at
    owner = np.searchsorted(starts, at, side="right")
    done = np.cumsum(lower) - lower  # such positions before this one
    first = np.searchsorted(owner, owner)
    wait = done > done[first]
    if wait.any():
        queue.push(rank, np.setdiff1d(every, at[~wait], assume_unique=True))
    return at[~wait]


_DOUBLE = re.compile(r"\s\s")
_LONE_SPACE = re.compile(r"(?<=\S)(?= \S)")


class Encoder:
    """Encodes slices of texts to ids, as little-endian unsigned 32-bit integers.

    A text is cut where one space stands between two other characters: no match
    of the pattern reaches over such a place, and none looks ahead beyond it, so
    the cuts do not change the ids.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        self.queue = RankQueue(vocabulary.size)
        #: The ids of the parts of the slice before.
        self.known: dict[str, bytes] = {}

    def _learn(self, parts: set[str]) -> None:
        """Make ``known`` hold the ids of these parts, and of no others."""
        old, get = self.known, self.vocabulary.ranks.get
        self.known = known = {part: old[part] for part in parts.intersection(old)}
        words, mixed = [], []
        for part in parts.difference(old):
            # ASCII letters, perhaps with one space before them, are a single match of the pattern.
            (words if part.isascii() and (part[1:] if part[:1] == " " else part).isalpha() else mixed).append(part)
        matches = [self.find(part) for part in mixed]
        pieces = [*dict.fromkeys([*words, *(x for found in matches for x in found)])]
        coded = list(map(str.encode, pieces))
        ids = [-1 if (rank := get(piece)) is None else rank for piece in coded]
        merged = iter(merge([piece for piece, rank in zip(coded, ids) if rank < 0], self.vocabulary, self.queue))
        told = {piece: next(merged) if rank < 0 else rank.to_bytes(4, "little") for piece, rank in zip(pieces, ids)}
        known.update(zip(words, map(told.__getitem__, words)))
        for part, found in zip(mixed, matches):
            known[part] = b"".join(map(told.__getitem__, found))

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = []
        for text in texts:
            if _DOUBLE.search(text) or "\0" in text:
                split.append(_LONE_SPACE.split(text))
            else:
                split.append(text.replace(" ", "\0 ").split("\0"))
        self._learn(set().union(*split))
        get = self.known.__getitem__
        return [b"".join(map(get, parts)) for parts in split]


@lru_cache(maxsize=1)
def _vocabulary(path: str) -> Vocabulary:
    """One for each Python worker: its size is fixed, about 30 MB."""
    return Vocabulary(load_ranks(path))


def _decoder(path: str):
    """A function from lists of ids (binary) to the bytes that they stand for."""
    ranks = load_ranks(path)
    words = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        words[rank] = token
    vocabulary = pa.array(words, pa.large_binary())

    def decoded(rows: list[bytes]) -> list[bytes]:
        taken = vocabulary.take(pa.array(np.frombuffer(b"".join(rows), dtype="<u4").astype(np.int64)))
        if not len(taken):
            return [b""] * len(rows)
        # All tokens lie one after another; each row's bytes are a stretch of them.
        bounds = np.frombuffer(taken.buffers()[1], dtype=np.int64)[np.cumsum([0, *(len(ids) // 4 for ids in rows)])].tolist()
        data = taken.buffers()[2].to_pybytes()
        return [data[x:y] for x, y in zip(bounds, bounds[1:])]

    return decoded


def encode(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, decoded: str | None = None
) -> DataFrame:
    """(id, n_bytes, n_tokens, ids): ids as binary, four little-endian bytes a token.

    A null or empty text has no tokens. Each input row gives one row, equal rows and
    null ids too; other columns are dropped, whatever their names. There are no ties:
    within a pre-token the leftmost of equal pairs is merged first. An empty table gives
    an empty result. A very long text takes about 100 bytes of a worker's memory for
    each of its bytes. The vocabulary file must be at ``path`` on each executor.

    ``decoded`` names one more column, for the bytes that ``decode`` gives for the ids,
    made by the same task.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    pattern = pattern or public_tokenizers.PATTERN

    def make():
        encoder, back = Encoder(_vocabulary(path), pattern), _decoder(path) if decoded else None

        def work(texts):
            texts = [text or "" for text in texts]
            ids = encoder(texts)
            rows = [(len(text.encode()), len(x) // 4, x) for text, x in zip(texts, ids)]
            return [(*row, x) for row, x in zip(rows, back(ids))] if back else rows

        return work

    schema = "n_bytes long, n_tokens long, ids binary" + (f", {decoded} binary" if decoded else "")
    return per_text(df, [id_col], text_col, schema, make, SLICE)


def decode(df: DataFrame, ids_col: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Add the decoded bytes of each row's ids as column ``out``.

    Bytes and not a string, since ids may end within a character. Null ids give
    null. An id outside the vocabulary is an error.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    names = df.columns
    at = names.index(ids_col)

    def run(batches):
        back = _decoder(path)
        for batch in (part for whole in batches for part in slices(whole, at)):
            ids = batch.column(at).to_pylist()
            made = [None if x is None else y for x, y in zip(ids, back([x or b"" for x in ids]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*names, out])
        release()

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` binary"]))


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of the ids and of the decoded bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = encode(docs, decoded="decoded")
    return both.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
