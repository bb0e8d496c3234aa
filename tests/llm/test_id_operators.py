"""Files of token ids, alignments of two vocabularies and ranked search, against libraries and brute force."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from ledgerlake.llm import id_files, ranked_search, token_alignment
from ledgerlake.llm.common import spelling

ODD = [
    "", " ", "\n", "a", "  a  b ", "Don't WE'LL go, x'tra 1234 ²½", "é日本🎉 ñandú ÀÉÎ", "\t\x00z", "a" * 3000, "ab " * 3000, "▁<s> ▁", "x\x1cy \x85z  q",
    "x <|endoftext|>y <|startoftext|>", "é ́e İI", "the cat, the hat; (the) mat!!! ...", "foo  bar\t\tbaz \n\n qux", "ǅ ﬁ K", "<0x41> <unk>",
]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    letters = "aabbcde  \n.,'sdtm09é日🎉ÑI<|>"
    return ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(70))) for _ in range(300)]


def table(spark, texts):
    """Repeated rows, a null text, a null id, and columns whose names clash with results and helpers."""
    data = [(i, t, 7, "s", 1) for i, t in enumerate(texts)] + [(0, texts[0], 7, "s", 1), (3, "other text", 7, "s", 1), (10_000, None, 1, None, 1), (None, "x y", 1, "s", 1)]
    return spark.createDataFrame(data, "doc_id long, text string, n_tokens int, start string, lot int"), data


# ---- files


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_blocks_come_back(n):
    rnd = np.random.default_rng(n)
    for high in (1, 2, 300, 49_000, 1 << 32):
        ids = rnd.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
        ids[rnd.random(n) < 0.05] = high - 1
        blocks = id_files.pack(ids)
        assert id_files.unpack(*blocks[:4], memoryview(blocks[4]))[:n].tolist() == ids.tolist()
        assert len(blocks[4]) <= len(ids) * 4 + 6 * 1024 + 4096
    # A few large ids do not widen a block: they are exceptions.
    ids = np.array([7] * 1000 + [4_000_000_000] * 24, dtype=np.uint32)
    starts, least, widths, counts, data = id_files.pack(ids)
    assert (widths.tolist(), counts.tolist(), len(data)) == ([0], [24], 24 * 6)


def expected(data, encode):
    """Rows by id, the null one first; rows that share an id in any order."""
    return sorted([(-1 if d[0] is None else d[0], encode(d[1] or "") + [2]) for d in data])


def test_files_hold_the_ids_of_the_library(spark, texts, tmp_path):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    df, data = table(spark, texts)
    want = expected(data, lambda t: library.encode(t, add_special_tokens=False).ids)
    for shards in (None, 5):
        path = str(tmp_path / f"ids{shards}")
        id_files.write_ids(df, path, shards=shards)
        got = id_files.read_ids(spark, path).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids"]) for r in got) == want
        at = 0
        flat = []
        for r in sorted(got, key=lambda r: r["start"]):
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]), zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"])))
            at += r["n_tokens"]
            flat += r["ids"]
        order = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
        assert order == sorted(order)
        for begin, end in ((0, 10), (1000, 1030), (17, 4000), (at - 5, at + 50), (at, at + 1)):
            runs = id_files.read_slice(spark, path, begin, end).collect()
            assert [i for r in sorted(runs, key=lambda r: r["at"]) for i in r["ids"]] == flat[begin:end]


def test_files_of_an_empty_table_and_of_one_long_text(spark, tmp_path):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    empty = spark.createDataFrame([], "doc_id long, text string")
    id_files.write_ids(empty, str(tmp_path / "none"))
    assert id_files.read_ids(spark, str(tmp_path / "none")).count() == 0
    rnd = random.Random(1)
    long = " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9))) for _ in range(200_000))
    id_files.write_ids(spark.createDataFrame([(1, long), (2, "b")], "doc_id long, text string"), str(tmp_path / "long"))
    rows = {r["doc_id"]: r for r in id_files.read_ids(spark, str(tmp_path / "long"), ids=False).collect()}
    ids = library.encode(long, add_special_tokens=False).ids + [2]
    assert (rows[1]["n_tokens"], rows[1]["ids_crc32"], rows[2]["start"]) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), len(ids))


def test_other_bytes_are_no_segment():
    with pytest.raises(ValueError):
        id_files.Segment(memoryview(b"x" * 200), 0)


# ---- alignments


def aligned_by_hand(data):
    """Whole texts by both libraries, every pair of tokens tried."""
    import sentencepiece
    import tokenizers

    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    byte = {c: b for b, c in enumerate(spelling())}
    of_a = {i: bytes(byte.get(c, 0) for c in w) for w, i in library.get_vocab().items()}
    of_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in range(32_000)]
    out = []
    for row in data:
        text = row[1] or ""
        a, b = library.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        whole = (" " + text).encode()
        if not text or b"".join(of_a[i] for i in a) != whole or b"".join(of_b[i] for i in b) != whole:
            out.append((row[0], [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(of_a[i]) for i in a]).tolist(), np.cumsum([len(of_b[i]) for i in b]).tolist()
        groups, starts, links = [], (0, 0), []
        for end in sorted(set(ends_a) & set(ends_b)):
            to = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((a[starts[0] : to[0]], b[starts[1] : to[1]]))
            for i in range(starts[0], to[0]):
                for j in range(starts[1], to[1]):
                    if max(ends_a[i - 1] if i else 0, ends_b[j - 1] if j else 0) < min(ends_a[i], ends_b[j]):
                        links.append((a[i], b[j]))
            starts = to
        out.append((row[0], a, b, groups, links))
    return out


@pytest.mark.parametrize("lot_bytes", [500, 1 << 23])
def test_alignments_match_all_pairs_of_tokens(spark, texts, lot_bytes):
    df, data = table(spark, [t for t in texts if len(t) < 1000])
    want, counts = aligned_by_hand(data), Counter()
    for *_, links in want:
        counts.update(links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    rows = []
    for doc, a, b, groups, links in want:
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((doc, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(told.encode()).hexdigest() if a else ""))
    got = [tuple(r) for r in token_alignment.align(df, lot_bytes=lot_bytes).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
    assert any(r[1] == 0 and r[0] not in (0, 10_000, None) for r in rows)  # a text whose bytes do not come back
    pairs = {(r["a_id"], r["b_id"]): (r["n"], r["best"]) for r in token_alignment.pair_counts(df, lot_bytes=lot_bytes).collect()}
    assert pairs == {k: (n, n == most[k[1]]) for k, n in counts.items()}


def test_alignments_give_ids_and_ends_of_groups(spark, texts):
    df, data = table(spark, [t for t in texts if len(t) < 1000])
    got = {(r["doc_id"], tuple(r["a_ids"]), tuple(r["b_ids"])): list(zip(r["a_ends"], r["b_ends"])) for r in token_alignment.alignments(df).collect()}
    for doc, a, b, groups, _ in aligned_by_hand(data):
        ends = list(zip(np.cumsum([len(x) for x, _ in groups]).tolist(), np.cumsum([len(y) for _, y in groups]).tolist()))
        assert got[(doc, tuple(a), tuple(b))] == ends


def test_a_text_in_parts_is_aligned_as_a_whole(monkeypatch):
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choice("abcdeé'.,") for _ in range(rnd.randrange(1, 9))) for _ in range(3000)) + "  end "
    aligner = token_alignment.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    whole = aligner.documents([text, "a b"])
    monkeypatch.setattr(token_alignment, "PART", 500)
    parts = aligner.documents([text, "a b"])
    for x, y in zip(whole, parts):
        assert x[:4] == y[:4] and x[4].tolist() == y[4].tolist() and x[5].tolist() == y[5].tolist()


def test_an_empty_table_has_no_alignments(spark):
    assert token_alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- ranked search

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return _TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def ranked_by_hand(docs, items, k=20):
    """docs: (id, text) rows; items: id to the texts of it."""
    found = [(d, Counter(cut(t)), len(cut(t))) for d, t in docs]
    n_docs, length = sum(n > 0 for *_, n in found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    rows = []
    for item, texts in items.items():
        asked, scored = Counter(t for text in set(texts) for t in cut(text)), []
        for doc, counts, n in found:
            score = 0
            for t, times in asked.items():
                if counts[t]:
                    m = 100 - 25 + (25 * n * n_docs) // length
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 12 * m))
            if score > 0 and doc is not None:
                scored.append((-score, doc))
        rows += [(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(scored)[:k], 1)]
    return rows


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(7)
    words = [*"abcdefghij", "Ab", "ab", "é", "É", "x1", "日本", "the", "THE"]
    line = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", ",", "--", "\t"]) for _ in range(n))
    docs = [(i, line(rnd.randrange(0, 40))) for i in range(200)] + [(1000 + i, "the the a copy") for i in range(60)]
    docs += [(3, "a b c"), (3, "a b c"), (None, "a b the"), (500, None), (501, " ,;"), (502, "b " * 5000)]
    items = {i: [line(rnd.randrange(1, 12))] for i in range(30)} | {40: ["the copy"], 41: [" .. "], 42: ["nowhere"], 43: ["a a a b", "c the"], 44: ["the " * 70]}
    return docs, items


@pytest.mark.parametrize("changes", [{}, {"DOC_TILE": 7, "ITEM_TILE": 4}])
def test_ranks_match_all_documents_by_all_items(spark, corpus, changes, monkeypatch):
    for name, value in changes.items():
        monkeypatch.setattr(ranked_search, name, value)
    docs, items = corpus
    df = spark.createDataFrame([(d, t, 5, 5) for d, t in docs], "doc_id long, text string, score int, item int").repartition(3)
    asked = [(i, t, 1) for i, texts in items.items() for t in [*texts, texts[0]]] + [(None, "a", 1), (99, None, 1)]
    got = ranked_search.search(df, spark.createDataFrame(asked, "item_id long, text string, rank int"), group_bytes=600 if changes else ranked_search.GROUP_BYTES)
    assert sorted(map(tuple, got.collect())) == sorted(ranked_by_hand(docs, items))


def test_partial_sums_stay_below_two_to_the_53():
    sums = np.array([[6.0, 3, 2, 9, 1], [1.0, 1, 1, 1, 1]])
    assert ranked_search.blocks(sums, 4, 10) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    counts = np.array([0, 1, 250_000])
    assert [x.tolist() for x in ranked_search.layers(counts)] == [[0, 1, 100_000], [0, 0, 100_000], [0, 0, 50_000]]
    largest = ranked_search.REPEATS * 1000 * math.log(2.0**63) * ranked_search.IMPACT
    assert largest < ranked_search.EXACT  # one column by itself


@pytest.mark.parametrize(("most", "limit", "repeats"), [(4096, 1 << 53, 100_000), (2, 1 << 53, 3), (3, 40_000_000, 2)])
def test_a_tile_is_the_product_of_whole_numbers(most, limit, repeats, monkeypatch):
    monkeypatch.setattr(ranked_search, "REPEATS", repeats)
    rnd = np.random.default_rng(3)
    counts, impacts, weights = rnd.integers(0, 9, (5, 12)) * (rnd.random((5, 12)) < 0.4), rnd.integers(1, 10**6, (9, 20)) * (rnd.random((9, 20)) < 0.5), rnd.integers(0, 9, 20)
    vocabulary = np.array([0, 2, 3, 5, 7, 8, 11, 13, 14, 16, 18, 19])
    (of, place), (doc, code) = np.nonzero(counts), np.nonzero(impacts)
    tile = (0, 5, vocabulary, of, place, counts[of, place])
    got = ranked_search.tile_scores(tile, weights, code, impacts[doc, code], doc, 9, most, limit)
    assert got.tolist() == ((counts * weights[vocabulary]) @ impacts[:, vocabulary].T).tolist()


def test_empty_tables_have_no_ranks(spark, corpus):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(none, items).count() == 0
    some = ranked_search.search(spark.createDataFrame(corpus[0][:3], "doc_id long, text string"), none.withColumnRenamed("doc_id", "item_id"))
    assert (some.count(), some.columns) == (0, ["item_id", "rank", "doc_id", "score"])
