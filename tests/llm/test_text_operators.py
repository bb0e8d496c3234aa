"""The operators that read one text at a time, against libraries and brute force."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest

from ledgerlake.llm import byte_bpe, license_scan, token_counts, toxicity

ODD = ["", " ", "\n", "a", "  a  b ", "Hello, world! it's 42  x", "é日本🎉", "\t\x00z", "a" * 5000, "ab " * 3000, "one word " * 120_000, "▁<s>", "x\x1cy \x85z"]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    letters = "aabbcde  \n.,'sd09é日🎉"
    return ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(300)]


def rows(spark, texts):
    """Null text and id, repeated rows, and extra columns whose names clash with results."""
    data = [(i, t, 7, "s") for i, t in enumerate(texts)] + [(0, texts[0], 7, "s"), (10_000, None, 1, None), (None, "x y", 1, "s")]
    return spark.createDataFrame(data, "doc_id long, text string, n_tokens int, score string")


def test_token_counts_match_the_library(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = token_counts.count_tokens(rows(spark, texts), limit=20).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        text = "x y" if r["doc_id"] is None else "" if r["doc_id"] == 10_000 else texts[r["doc_id"]]
        assert (r["n_tokens"], r["n_bytes"]) == (len(model.encode(text)), len(text.encode()))
        assert r["over_limit"] == (r["n_tokens"] > 20)


def test_prefix_counts_are_exact_at_every_prefix(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    some = [t for t in texts if len(t) < 80][:60]
    counts = {r["doc_id"]: r["counts"] for r in token_counts.prefix_counts(rows(spark, some)).where("doc_id < 10000").collect()}
    for i, text in enumerate(some):
        assert counts[i] == [len(model.encode(text[:k])) for k in range(len(text) + 1)]
    short = token_counts.truncate(rows(spark, some), 7).collect()
    assert len(short) == len(some) + 3
    assert [r["text"] for r in short if r["doc_id"] is None] == ["x y"] and [r["text"] for r in short if r["doc_id"] == 10_000] == [None]
    cut = {r["doc_id"]: r["text"] for r in short if r["doc_id"] is not None}
    for i, text in enumerate(some):
        assert cut[i] == text[: max(k for k, n in enumerate(counts[i]) if n <= 7)]


def test_byte_bpe_matches_the_library_and_round_trips(spark, texts):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.decode(byte_bpe.encode(rows(spark, texts))).collect()
    assert len(got) == len(texts) + 3
    for r in got:
        text = "x y" if r["doc_id"] is None else "" if r["doc_id"] == 10_000 else texts[r["doc_id"]]
        assert bytes(r["ids"]) == np.array(library.encode_ordinary(text), dtype="<u4").tobytes()
        assert bytes(r["decoded"]) == text.encode()
    twice = byte_bpe.decode(byte_bpe.encode(rows(spark, texts), decoded="again"))
    assert twice.where("again <> decoded OR again IS NULL").count() == 0
    ids = spark.createDataFrame([(None,), (bytearray(),)], "ids binary")
    assert {(r[0] is None, r[1] is None or bytes(r[1])) for r in byte_bpe.decode(ids).collect()} == {(True, True), (False, b"")}


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary(byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")))


def test_very_long_pre_tokens(vocabulary):
    import tiktoken

    rnd = random.Random(9)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    encoder = byte_bpe.Encoder(vocabulary, P.PATTERN)
    texts = [base64.b64encode(hashlib.sha512(b"x").digest() * 400).decode(), "a" * 50_000, "ab" * 20_000, "=" * 30_001, "日本" * 8_000]
    texts += ["".join(rnd.choice(letters) for _ in range(20_000)) for letters in ("etaoin", "ab", "abcdefghijklmnopqrstuvwxyz")]
    for text, ids in zip(texts, encoder(texts)):
        assert ids == np.array(library.encode_ordinary(text), dtype="<u4").tobytes()
    assert not encoder.queue.top


def test_merges_that_make_a_lower_rank():
    # Of "abc", "ab" is merged first only where "bc" is no token; then "abc" comes before other pairs "ab".
    import tiktoken

    rnd = random.Random(10)
    for _ in range(40):
        tokens = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(2, 5))).encode() for _ in range(30)} - {b"a", b"b", b"c"})
        rnd.shuffle(tokens)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(tokens)}
        vocabulary = byte_bpe.Vocabulary(ranks)
        library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        queue = byte_bpe.RankQueue(vocabulary.size)
        pieces = [bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(5, 90))) for _ in range(30)]
        for piece, ids in zip(pieces, byte_bpe.merge(pieces, vocabulary, queue)):
            assert ids == np.array(library.encode_ordinary(piece.decode()), dtype="<u4").tobytes()


def brute_license(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        run = phrase.split()
        for i in range(len(words) - len(run) + 1):
            if words[i : i + len(run)] == run:
                places.append(i)
                labels.add(label)
    return len(words), sorted(places), ",".join(sorted(labels))


def words_at(text, k, n):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())[k : k + n]


def test_license_phrases_and_templates(spark):
    rnd = random.Random(5)
    words = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "x1", "licensed", "under", "the", "apache"]
    texts = ["", "CC-BY! cc by", *(" ".join(rnd.choice(words) for _ in range(rnd.randrange(60))) for _ in range(300))]
    texts += ["foo " + text + " bar" for _, text in license_scan.TEMPLATES]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(rows(spark, texts)).where("doc_id < 10000").dropDuplicates(["doc_id"]).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r["n_words"], sorted(r["base_places"]), r["base_labels"]) == brute_license(text)
        assert 0 <= r["score"] <= 1
        if not r["spans"]:  # then base phrases alone count, each word once
            inside = {k for phrase in license_scan.PHRASES for n in [len(phrase.split())] for k0 in r["base_places"] if words_at(text, k0, n) == phrase.split() for k in range(k0, k0 + n)}
            assert r["score"] == pytest.approx(len(inside) / r["n_words"] if r["n_words"] else 0)
    for k, (label, _) in enumerate(license_scan.TEMPLATES):
        assert label in got[len(texts) - len(license_scan.TEMPLATES) + k]["labels"].split(",")


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(1)
    prose = ["".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(rnd.randrange(2, 9))) for _ in range(400)]
    insults = ["moronic", "worthless", "disgusting", "pathetic"]
    data, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = [rnd.choice(prose) for _ in range(120)]
        if toxic:
            for k in range(12):
                text[rnd.randrange(120)] = rnd.choice(insults)
        data.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*data, (9000, None), (9001, "")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (1, None)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[9000] == got[9001]
    held = [i for i in range(600) if toxicity.zlib.crc32(str(i).encode()) % 5 == 0]
    assert {r["h"] for r in spark.createDataFrame([(None,)], "doc_id long").select(toxicity.held_out("doc_id").alias("h")).collect()} == {False}
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.95 * len(held)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).first()["score"] == pytest.approx(0.5)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(none).count() == 0
    assert byte_bpe.decode(byte_bpe.encode(none)).count() == 0
    assert license_scan.scan_licenses(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
