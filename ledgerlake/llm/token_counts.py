"""Exact token counts at every prefix, by prefix dynamic programming.

In a BPE encoding, whether two tokens may stand side by side depends on these two
only: they may if encoding their joined text gives just these two. So the last
token of every prefix is unique, and

    count(prefix ending at i) = count(prefix ending at i - len(last token)) + 1

where the last token is the one that ends at i, is made by merges from its own
characters, and may follow the last token of the shorter prefix. One pass from
left to right stores the count at each prefix. With these counts, "how many
tokens has this text", "how many has its first half" and "where must it be cut to
keep 4096 tokens" are look-ups and need no further encoding.

The vocabulary is a piece model with byte fallback: characters outside it count
one token for each UTF-8 byte. No piece holds a space mark after another
character (asserted when the model is loaded), so counts of the chunks that start
at space marks add up; chunks that come again are looked up in tables of bounded
size (1.5 million short chunks), which a worker keeps for its next task. Texts stay in their tasks: nothing is shuffled.
"""

from __future__ import annotations

from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import Memo, per_text

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
LIMIT = 4096


class PrefixCounter:
    """Token counts of the prefixes of a text, for one piece model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        #: Piece to rank: a lower rank is merged first.
        self.rank = {
            model.id_to_piece(i): -model.get_score(i) for i in range(model.get_piece_size()) if not special(i)
        }
        if any(SPACE in piece.lstrip(SPACE) for piece in self.rank):
            raise ValueError("a piece of this model reaches over a space mark; counts of chunks would not add up")
        #: Pieces that merges make of their own characters, numbered; no other one can be a last token.
        self.pieces = [piece for piece in self.rank if self._merge(piece) == [piece]]
        self.number = {piece: i for i, piece in enumerate(self.pieces)}
        #: By the last two characters of a piece, the length of the longest such piece.
        self.reach: dict[str, int] = {}
        for piece in self.pieces:
            self.reach[piece[-2:]] = max(self.reach.get(piece[-2:], 0), len(piece))
        self.fits = Memo(self._may_follow, 1 << 20)
        #: Pairs of characters that stand side by side in some piece; merges never reach over any other pair.
        self.inside = {piece[i : i + 2] for piece in self.rank for i in range(len(piece) - 1)}
        self.part = Memo(lambda text: bytes(self.prefixes(text)), 600_000)
        self.chunk = Memo(self._of_parts, 900_000)

    def _merge(self, text: str) -> list[str]:
        """The encoding of a short text by its definition; it decides which pairs may stand side by side."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = min((rank.get(a + b, 1e18), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1e18:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, pair: int) -> bool:
        left, right = self.pieces[pair >> 20], self.pieces[pair & 0xFFFFF]
        return self._merge(left + right) == [left, right]

    def _of_parts(self, chunk: str) -> bytes:
        """The counts of a short chunk from those of the parts between which no merge is possible."""
        inside, n = self.inside, len(chunk)
        cuts = [i for i in range(1, n) if chunk[i - 1 : i + 1] not in inside]
        if not cuts:
            return self.part[chunk]
        out, done = bytearray(1), 0
        for a, b in zip([0, *cuts], [*cuts, n]):
            counts = self.part[chunk[a:b]]
            out += bytes([done + x for x in counts[1:]])
            done += counts[-1]
        return bytes(out)

    def prefixes(self, chunk: str) -> list[int]:
        """counts[i]: tokens of the first i characters of a chunk in which spaces are space marks."""
        n, number, reach, fits = len(chunk), self.number.get, self.reach, self.fits
        counts, last = [0] * (n + 1), [-1] * (n + 1)
        for end in range(1, n + 1):
            long = reach.get(chunk[end - 2 : end], 1) if end > 1 else 1
            for start in range(end - long if end > long else 0, end):
                token = number(chunk[start:end])
                if token is not None and (last[start] < 0 or fits[last[start] << 20 | token]):
                    counts[end], last[end] = counts[start] + 1, token
                    break
            else:  # not in the vocabulary: one token a byte, and no merge reaches over it
                counts[end] = counts[end - 1] + len(chunk[end - 1].encode())
        return counts

    def chunks(self, text: str) -> list[str]:
        """The normalised text, cut before each run of space marks."""
        parts = text.replace(SPACE, " ").split(" ")
        if "" not in parts:
            return [SPACE + part for part in parts]
        out, marks = [], ""
        for part in parts:
            marks += SPACE
            if part:
                out.append(marks + part)
                marks = ""
        return [*out, marks] if marks else out

    def of_chunks(self, text: str) -> list[list[int]]:
        return [self.chunk[x] if len(x) <= 60 else self.prefixes(x) for x in self.chunks(text)] if text else []


@lru_cache(maxsize=2)
def _counter(path: str) -> PrefixCounter:
    """One for each Python worker; its tables are bounded by numbers of short chunks."""
    return PrefixCounter(path)


def _every_prefix(counter: PrefixCounter, text: str) -> list[int]:
    """counts[i]: tokens of text[:i]; the mark put before the text counts with its first character."""
    out, done = [0], 0
    for counts in counter.of_chunks(text):
        out += [done + x for x in counts[1:]]
        done += counts[-1]
    del out[1:2]  # the mark before the text is no character of it
    return out if text else [0]


def _cut(parts: list[list[int]], limit: int) -> int:
    """Characters of the longest prefix that holds at most ``limit`` tokens."""
    done = at = best = 0
    for counts in parts:
        # Counts may fall by a merge: the longest prefix need not be the first that passes the limit.
        if done + max(counts) <= limit:
            best = at + len(counts) - 1
        else:
            best = max([best, *(at + i for i, c in enumerate(counts) if i and done + c <= limit)])
        done += counts[-1]
        at += len(counts) - 1
        if done > limit + 64:
            break
    return max(0, best - 1)


def count_tokens(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, path: str | None = None
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, cut_chars) for each row.

    cut_chars: characters of the longest prefix of the text that has at most
    ``limit`` tokens (the whole text where it has no more). A null text counts as
    empty: no bytes, no tokens. Each input row gives one row, equal rows and rows
    with a null id too; other columns are dropped, whatever their names. There are
    no ties. An empty table gives an empty result. A very long text takes about 100
    bytes of a worker's memory for each of its characters.
    """
    path = path or public_tokenizers.path(MODEL)

    def make():
        counter = _counter(path)

        def work(texts):
            out = []
            for text in texts:
                parts = counter.of_chunks(text) if text else []
                n = sum([x[-1] for x in parts])
                cut = len(text or "") if n <= limit else _cut(parts, limit)
                out.append((len(text.encode()) if text else 0, n, n > limit, cut))
            return out

        return work

    return per_text(df, [id_col], text_col, "n_bytes long, n_tokens long, over_limit boolean, cut_chars long", make)


def prefix_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, counts): counts[i] is the exact number of tokens of the text's first i characters.

    An array of one more element than the text has characters; [0] for a null or
    empty text. ``counts[i]`` answers any budget question about a prefix.
    """
    path = path or public_tokenizers.path(MODEL)

    def make():
        counter = _counter(path)
        return lambda texts: [(_every_prefix(counter, text or ""),) for text in texts]

    return per_text(df, [id_col], text_col, "counts array<int>", make)


def truncate(df: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, text): the longest prefix of each text that has at most ``limit`` tokens; null stays null.

    Each row is cut by itself: null ids, repeated ids and equal rows all come back.
    """
    path = path or public_tokenizers.path(MODEL)

    def make():
        counter = _counter(path)
        return lambda texts: [(text and text[: _cut(counter.of_chunks(text), limit)],) for text in texts]

    cut = per_text(df.select(F.col(id_col), F.col(text_col).cast("string").alias("__whole")), [id_col], "__whole", "__cut string", make)
    return cut.select(F.col(id_col), F.col("__cut").alias(text_col))


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document and whether it goes over 4096."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
