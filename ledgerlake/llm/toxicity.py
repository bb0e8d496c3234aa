"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on text labelled toxic and one on
ordinary text. A text is cut into overlapping windows; each is compressed with
either dictionary, and the bytes that the toxic dictionary saves over the ordinary
one tell how much the window resembles toxic text. The mean and the largest gain
of a text's windows become a probability by a logistic curve, and the weights of
that curve (with it the threshold: probability 0.5) are calibrated on labelled rows
that trained no dictionary.

What makes the gains comparable: both dictionaries share a background trained on
ordinary text, and differ in an equally long last part, trained on words that are
much more frequent in one class than in the other. So ordinary prose compresses
alike with both.

The fit uses a bounded sample of labelled rows (``max_toxic`` and ``max_ordinary`` of
them, documented parameters), each with its whole text. The model is
about 70 kB at any size. Scoring reads every window of every whole text, in tasks,
without a shuffle.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import per_text

WINDOW, STRIDE = 512, 256
BACKGROUND, OWN = 32_768, 2_000
MAX_TOXIC, MAX_ORDINARY = 1_500, 4_500

_WORDS = re.compile(r"[^\W_]+")


def normalise(text: str | None) -> bytes:
    """Words in lower case, with single spaces."""
    return " ".join(_WORDS.findall(text.lower())).encode() if text else b""


def windows(data: bytes) -> list[bytes]:
    """Overlapping windows over the whole text; one (perhaps empty) at least."""
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data) - STRIDE), STRIDE)]


@dataclass(frozen=True)
class ToxicityModel:
    """Dictionaries of both classes (empty where a class had no rows) and the weights of the curve."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, float, float]

    def features(self):
        """A function from normalised text to (mean gain, largest gain)."""
        if not self.toxic:
            return lambda data: (0.0, 0.0)
        a, b = _compressor(self.toxic), _compressor(self.ordinary)

        def gains(data: bytes) -> tuple[float, float]:
            got = [len(b(w)) - len(a(w)) for w in windows(data)]
            return sum(got) / len(got), float(max(got))

        return gains

    def probability(self, mean: float, top: float) -> float:
        z = self.weights[0] + self.weights[1] * mean + self.weights[2] * top
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _compressor(dictionary: bytes):
    import zstandard

    params = zstandard.ZstdCompressionParameters.from_level(
        6,
        dict_size=len(dictionary),
        source_size=WINDOW,
        min_match=4,
        write_content_size=0,
        write_checksum=0,
        write_dict_id=0,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    trained = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=trained, compression_params=params).compress


def _train(samples: list[bytes], size: int, k: int) -> bytes:
    """The last ``size`` bytes of a dictionary trained on the samples; of the samples themselves where they are too few."""
    import zstandard

    samples = [s for s in samples if len(s) >= 8]
    if not samples:
        return b""
    while len(samples) < 300:
        samples = samples + samples
    try:
        return zstandard.train_dictionary(size + 400, samples, k=k, d=6, f=18, steps=1).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def _pieces(data: bytes, n: int) -> list[bytes]:
    return [data[i : i + n] for i in range(0, len(data), n)]


def _one_of_each_copy(docs: list[bytes]) -> list[bytes]:
    """Drop most copies: texts whose longer words have the same smallest hash."""
    seen: dict = {}
    for data in docs:
        seen.setdefault(min((zlib.crc32(w) for w in data.split() if len(w) >= 8), default=data), data)
    return list(seen.values())


def _telling(docs: list[bytes], own: Counter, n_own: int, other: Counter, n_other: int) -> list[bytes]:
    """Of each text, the words that are eight times as frequent in its class as in the other."""
    least = max(3, round(n_own / 60))
    tells = {w for w, n in own.items() if n >= least and 8 * (other[w] + 0.5) / n_other < n / n_own}
    return [b" ".join(sorted(tells.intersection(data.split()))) for data in docs]


def train(rows: list[tuple[int, str, int]]) -> ToxicityModel:
    """A model of (doc_id, text, label) rows.

    Of the ids, crc32 mod 5 == 1 calibrate; the others train the dictionaries.
    Without rows of one class every text gets the share of toxic rows.
    """
    rows = sorted(rows, key=lambda r: r[0])
    data = [(zlib.crc32(str(i).encode()) % 5 == 1, normalise(text), int(y)) for i, text, y in rows]
    toxic = _one_of_each_copy([d for hold, d, y in data if y and not hold])
    ordinary = _one_of_each_copy([d for hold, d, y in data if not y and not hold])
    share = (sum(y for *_, y in data) + 0.5) / (len(data) + 1)
    flat = ToxicityModel(b"", b"", (math.log(share / (1 - share)), 0.0, 0.0))
    if not toxic or not ordinary:
        return flat
    shuffled = random.Random(5)
    in_toxic, in_ordinary = Counter(), Counter()
    for docs, counter in ((toxic, in_toxic), (ordinary, in_ordinary)):
        for d in docs:
            counter.update(set(d.split()))
    prose = [p for d in ordinary for p in _pieces(d, 256)]
    shuffled.shuffle(prose)
    background = _train(prose, BACKGROUND, 64)
    parts = []
    for docs, own, other, n_other in ((toxic, in_toxic, in_ordinary, len(ordinary)), (ordinary, in_ordinary, in_toxic, len(toxic))):
        telling = [p for d in _telling(docs, own, len(docs), other, n_other) for p in _pieces(d, 64)]
        shuffled.shuffle(telling)
        parts.append(_train(telling, OWN, 16))
    if not parts[0]:
        return flat
    model = ToxicityModel(background + parts[0], background + parts[1], flat.weights)
    gains = model.features()
    held = [(*gains(d), y) for hold, d, y in data if hold] or [(*gains(d), y) for _, d, y in data]
    return ToxicityModel(model.toxic, model.ordinary, _calibrate(np.array(held, dtype=float)))


def _calibrate(rows: np.ndarray) -> tuple[float, float, float]:
    """Weights of the logistic curve, by Newton's method with a little shrinkage."""
    x, y = np.column_stack([np.ones(len(rows)), rows[:, :2]]), rows[:, 2]
    scale = np.maximum(1.0, np.abs(x).max(axis=0))
    x, w = x / scale, np.zeros(3)
    shrink = np.diag([0.01, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (y - p) - shrink @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w / scale)


def held_out(id_col: str):
    """Rows that learning never sees: crc32 of the id as text, mod 5, is 0. A null id has no labels and is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_toxic: int = MAX_TOXIC,
    max_ordinary: int = MAX_ORDINARY,
) -> ToxicityModel:
    """Learn from labelled rows that are not held out.

    Rows are chosen by a hash of their id, at most max_toxic and max_ordinary of
    them. Null labels and texts are left out; an id with several labels counts as
    toxic if one says so, and an id with several texts brings the first of them in
    order.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    known = known.join(docs.select(F.col(id_col).alias("__id")), "__id", "left_semi")
    order = F.xxhash64("__id")
    picked = known.where("__y = 1").orderBy(order, "__id").limit(max_toxic)
    picked = picked.unionByName(known.where("__y = 0").orderBy(order, "__id").limit(max_ordinary))
    ids = {r["__id"]: r["__y"] for r in picked.collect()}  # max_toxic + max_ordinary numbers at most
    if not ids:
        return train([])
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    few = F.broadcast(spark.createDataFrame(list(ids.items()), f"__id {kind}, __y int"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__t"))
    rows = texts.where(F.col("__t").isNotNull()).join(few, "__id").groupBy("__id", "__y").agg(F.min("__t").alias("__t"))
    return train([(r["__id"], r["__t"], r["__y"]) for r in rows.toLocalIterator()])  # a text for each id at most


def score(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, score, mean_gain, max_gain) for each row, from its whole text alone.

    A null or empty text has one empty window and gets the score of no gain. Each
    input row gives one row, equal rows and null ids too. ``keep`` names the columns to
    carry through; others are dropped, whatever their names. An empty table gives an
    empty result. A very long text takes about three times its size of a worker's
    memory. Texts that tie have the same score.
    """

    def make():
        gains = model.features()

        def work(texts):
            out = []
            for text in texts:
                mean, top = gains(normalise(text))
                out.append((model.probability(mean, top), mean, top))
            return out

        return work

    return per_text(df, keep or [id_col], text_col, "score double, mean_gain double, max_gain double", make)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score every document; learnt from the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
        "mean_gain",
        "max_gain",
    )
