"""The operators that compare documents with each other, against brute force on small tables."""

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import common, decontamination, line_dedup, near_dedup, secret_scan, substring_dedup, vector_search

WORDS = ["w%02d" % i for i in range(90)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def variants(seed, n, length):
    """Texts of which some are copies and some near copies of earlier ones."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        kind = rnd.random()
        if out and kind < 0.2:
            out.append(rnd.choice(out))
        elif out and kind < 0.7:
            words = rnd.choice(out).split(" ")
            for _ in range(rnd.randrange(1, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(WORDS)
            out.append(" ".join(words))
        else:
            out.append(" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, length))))
    return out


def similar(a, b, percent=80):
    common = len(a & b)
    return bool(a) and 100 * common >= percent * (len(a) + len(b) - common)


@pytest.mark.parametrize("words, block", [(4, 4096), (5, 2)])
def test_near_duplicates(spark, monkeypatch, words, block):
    monkeypatch.setattr(common, "BLOCK", block)  # 2: every key is dealt out
    texts = variants(1, 150, 60) + ["", "A b", "a B", " \t", "a b c d", "long " * 30_000, "x" * 500_000, "x" * 500_000]
    data = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (500, None), (None, texts[1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, component_id string")
    assert near_dedup.near_duplicates(docs.limit(0), words=words).count() == 0
    got = near_dedup.near_duplicates(docs, words=words).collect()
    assert len(got) == len(data)
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in range(a):
            if similar(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for r in got:
        i = r["doc_id"]
        if i is None or i == 500:
            assert r["kept"] and r["component_id"] == i
        else:
            assert (r["component_id"], r["n_shingles"]) == (find(i), len(sets[i]))


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    for n in (3, 40, 3000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: max(1, int(0.8 * n))], rng.integers(0, 1 << 63, n - max(1, int(0.8 * n))).astype(np.uint64)])
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        guess = (near_dedup.sketch(a, 2048) == near_dedup.sketch(b, 2048)).mean()
        assert abs(guess - truth) < 0.06


def brute_lines(texts, percent=80, least=1):
    seen, out = [], []
    for text in texts:
        kept = []
        for line in text.split("\n"):
            words = frozenset(re.findall(r"[^\x20\x09-\x0D]+", lower(line)))
            if len(words) < least or not words:
                kept.append(line)
                continue
            if not any(similar(words, s, percent) for s in seen):
                kept.append(line)
            seen.append(words)
        out.append("\n".join(kept))
    return out


@pytest.mark.parametrize("cold, percent", [(1024, 80), (1, 80), (1, 60)])
def test_line_dedup(spark, monkeypatch, cold, percent):
    monkeypatch.setattr(line_dedup, "COLD", cold)  # 1: every word takes the way of frequent words
    monkeypatch.setattr(line_dedup, "LISTS", 50)
    monkeypatch.setattr(common, "BLOCK", 16)  # and the lists of most words are dealt out
    lines = variants(2, 160, 30)
    # One word in all lines, short lines that repeat, and a set next to one that has a word more.
    texts = ["\n".join(f"the {x}" for x in lines[i : i + 3]) for i in range(0, len(lines), 3)]
    texts += ["", "\n\n", "a b\na b", "les.", "LES.\n\nles. les.", "a b c", "a b c d", " \t", "x" * 3000 + " y " + "é " * 2000 + "\n" + "z" * 3000, "x" * 3000 + " y é"]
    data = [(i, t, 1, "k", 0) for i, t in enumerate(texts)] + [(900, None, 1, "k", 0), (None, lines[0], 1, "k", 0), (3, texts[3], 1, "k", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_removed int, lang string, __cuts int")
    got = line_dedup.dedup_lines(docs, percent=percent).collect()
    assert len(got) == len(data)
    want = brute_lines(texts, percent)
    for r in got:
        if r["doc_id"] is None:
            assert r["text"] == lines[0]
        elif r["doc_id"] == 900:
            assert r["text"] is None and r["n_lines"] == 0
        else:
            assert r["text"] == want[r["doc_id"]] and r["lang"] == "k"
            assert r["n_lines"] == texts[r["doc_id"]].count("\n") + 1
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_word_hashes_tell_words_apart():
    rnd = random.Random(12)
    texts = ["".join(rnd.choice("aAbZ \t\n\x0b\x1cé日") for _ in range(rnd.randrange(60))) for _ in range(300)]
    texts += [None, "", "  ", "q" * 255, "q" * 256 + " " + "q" * 257 + " " + "Q" * 1000, "q" * 1000, "w" * 2_000_000]
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")) for t in texts]
    hashes, offsets = near_dedup.word_hashes(pa.array(["cut off", *texts, "cut off"]).slice(1, len(texts)))
    assert np.diff(offsets).tolist() == [len(w) for w in words]
    some = [t for t in texts if t is not None]  # without nulls arrays are read where they lie
    for kind in (pa.string(), pa.large_string()):
        again = near_dedup.word_hashes(pa.array(["Cut off " * 9, *some], kind).slice(1))
        assert again[0].tolist() == hashes.tolist() and again[1][-1] == len(hashes)
    told = dict(zip([w for some in words for w in some], hashes.tolist()))
    assert [told[w] for some in words for w in some] == hashes.tolist()
    assert len(set(told.values())) == len(told)


def test_line_dedup_before_blank_lines_at_a_batch_end(spark):
    # A borderline copy, 4 of 5 words, followed by blank lines only: its last word must count.
    texts = ["alpha beta gamma delta epsilon", "one two three four five six", "delta alpha gamma beta\n\n", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    assert {(r["id"], r["line"]) for r in line_dedup.repeated_lines(docs).collect()} == {(2, 0)}


def test_substring_dedup(spark):
    rnd = random.Random(4)
    sentence = lambda: " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 30))).capitalize() + rnd.choice([". ", "! ", ".\n"])
    shared = ["".join(sentence() for _ in range(6)) for _ in range(4)]
    texts = ["".join(rnd.choice(shared) if rnd.random() < 0.3 else sentence() for _ in range(rnd.randrange(1, 12))) for _ in range(50)] + ["", "\n", "x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(700, None), (None, texts[0])], "doc_id long, text string")
    assert substring_dedup.dedup_substrings(docs.limit(0)).count() == 0
    more = docs.unionByName(spark.createDataFrame([(3, texts[3]), (3, "A. B.")], docs.schema)).withColumn("n_removed", F.lit("k"))
    rows = substring_dedup.dedup_substrings(more).collect()
    assert len(rows) == len(texts) + 4
    assert sorted(r["n_sentences"] for r in rows if r["doc_id"] == 3) == sorted([2, *[len(substring_dedup.sentences(texts[3]))] * 2])
    found = substring_dedup.dedup_substrings(docs).collect()
    assert all(r["n_sentences"] == len(substring_dedup.sentences(texts[r["doc_id"]])) for r in found if r["doc_id"] is not None and r["doc_id"] < len(texts))
    got = {r["doc_id"]: r["text"] for r in found}
    first, hits = {}, defaultdict(set)
    for i, text in enumerate(texts):
        parts = substring_dedup.sentences(text)
        assert "".join(text[a:b] for a, b, _ in parts) == text
        for a, b in substring_dedup.spans(parts):
            key = tuple(p[2] for p in parts[a:b])
            if first.setdefault(key, (i, a)) != (i, a):
                hits[i].update(range(a, b))
    assert any(hits.values())
    for i, text in enumerate(texts):
        parts = substring_dedup.sentences(text)
        assert got[i] == "".join(text[a:b] for k, (a, b, _) in enumerate(parts) if k not in hits[i])
    assert got[700] is None and got[None] == texts[0]


def test_passages_are_cut_alike_wherever_they_stand():
    rnd = random.Random(14)
    run = lambda n: [f"q{rnd.randrange(10**6)}" for _ in range(n)]
    found = {kind: 0 for kind in ("bare", "stops", "list")}
    for kind in found:
        for k in range(200):
            passage = run(51 + k % 10 if k % 4 else 400)
            if kind == "stops":  # four sentences, the first and the last of which run into their surroundings
                passage = [w + "." if i % 13 == 12 else w for i, w in enumerate(passage)]
            if kind == "list":
                passage = [w + "," for w in passage]
            keys = []
            for _ in range(2):
                words = run(rnd.randrange(40)) + passage + run(rnd.randrange(40))
                parts = substring_dedup.sentences(" ".join(words))
                assert [w for p in parts for w in p[2]] == words
                keys.append({tuple(w for p in parts[a:b] for w in p[2]) for a, b in substring_dedup.spans(parts)})
            found[kind] += bool(keys[0] & keys[1])
    assert found == {kind: 200 for kind in found}
    # Words that come again and again: the same pieces at any offset.
    for period in (1, 2, 3, 7):
        passage = [f"r{i % period}" for i in range(60)]
        keys = []
        for before in (0, 5):
            parts = substring_dedup.sentences(" ".join(run(before) + passage))
            keys.append({tuple(w for p in parts[a:b] for w in p[2]) for a, b in substring_dedup.spans(parts)})
        assert keys[0] & keys[1]


def test_decontamination(spark):
    rnd = random.Random(6)
    run = lambda n: [rnd.choice(WORDS) + str(rnd.randrange(50)) for _ in range(n)]
    items = [run(40) for _ in range(5)] + [run(8), run(3)]
    leak = lambda w, p: [x if rnd.random() >= p else "zz" + x for x in w]
    docs = [run(50) + leak(items[0], 0.08) + run(50), run(30) + items[1], leak(items[2], 0.1)[:30] + run(9), run(200), run(5) + items[5] + run(5), items[6]]
    d = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in enumerate(docs)] + [(90, None), (91, ""), (None, " ".join(docs[0]))], "doc_id long, text string")
    b = spark.createDataFrame([(i, " \n".join(w)) for i, w in enumerate(items)] + [(50, None), (51, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contamination(d, b).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2), (4, 5), (5, 6)}
    assert got[1, 1]["start_word"] == 30 and got[1, 1]["n_equal"] == 40
    assert decontamination.contamination(d, b.limit(0)).count() == 0
    assert decontamination.contamination(d.limit(0), b).count() == 0


def test_decontamination_finds_all_that_its_rule_allows(spark):
    # All places of the replaced words; 26 words or more hold 13 to 25 that follow the rule as well.
    for n in range(1, 26):
        masks = decontamination.masks_for([n] if n < 13 else [])
        bits = [[sum(1 << (p + i) for i, c in enumerate(m) if c == "1") for p in range(n - len(m) + 1)] for m in masks]
        for places in itertools.combinations(range(n), n // 5):
            whole = (1 << n) - 1 - sum(1 << i for i in places)
            assert any(whole & b == b for some in bits for b in some), (n, places)
    rnd = random.Random(16)
    for _ in range(300):
        equal = np.array([rnd.random() < 0.75 for _ in range(rnd.randrange(1, 40))])
        all_ = [b - a for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if 100 * equal[a:b].sum() >= 80 * (b - a)]
        a, b, same = decontamination.longest_stretch(equal, 80, 13)
        assert (b - a >= 13) == (max(all_, default=0) >= 13)
        assert same == equal[a:b].sum() and 100 * same >= 80 * (b - a)
    # Replaced words at the edge, in a part of a bad whole, and in short items.
    item = lambda k, n: [f"i{k}w{j}" for j in range(n)]
    other = lambda words, *places: [x if i not in places else "zz" for i, x in enumerate(words)]
    cases = [(13, (0,)), (13, (2, 10)), (15, (3, 7, 11)), (20, (1, 9, 18)), (25, (4, 9, 14, 19, 24)), (40, (*range(14, 40, 2),)), (5, (2,)), (6, (3,)), (10, (3, 6))]
    wrong = [(13, (3, 6, 9)), (30, (*range(0, 30, 3),)), (5, (1, 3))]
    told = [(k, item(k, n), other(item(k, n), *places)) for k, (n, places) in enumerate(cases + wrong)]
    pad = ["p%d" % i for i in range(9)]
    d = spark.createDataFrame([(k, " ".join(pad + leak + pad)) for k, _, leak in told], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(words)) for k, words, _ in told], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contamination(d, b).collect()}
    assert got == {(k, k) for k in range(len(cases))}
    # Looser rules have masks of their own.
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contamination(d, b, percent=60).collect()}
    assert got == {(k, k) for k in range(len(told))}


def test_decontamination_equals_all_documents_against_all_items(spark):
    # Items of 1 to 16 words in one benchmark, from few words, so that most are met often, in part and next to wrong words.
    rnd = random.Random(23)
    run = lambda n: [rnd.choice("abcdefgh") for _ in range(n)]
    items = [run(n) for n in range(1, 17)] + [["qqq"], ["a", "b"], ["a", "b"]]
    docs = [run(rnd.choice([0, 1, 2, 5, 12, 40])) for _ in range(40)]
    for item in items[4:16]:
        docs.append(run(3) + [w if rnd.random() > 0.12 else "z" for w in item] + run(3))

    def holds(doc, item):
        least = min(13, len(item))
        for shift in range(-len(item), len(doc) + 1):
            same = [0 <= j + shift < len(doc) and doc[j + shift] == w for j, w in enumerate(item)]
            low, high = max(0, -shift), min(len(item), len(doc) - shift)
            if any(100 * sum(same[a:b]) >= 80 * (b - a) for a in range(low, high) for b in range(a + least, high + 1)):
                return True
        return False

    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contamination(d, b).collect()}
    assert set(got) == {(i, k) for i, doc in enumerate(docs) for k, item in enumerate(items) if holds(doc, item)}
    for (i, k), r in got.items():
        if len(items[k]) < 5:
            n = len(items[k])
            assert r["start_word"] == next(p for p in range(len(docs[i])) if docs[i][p : p + n] == items[k])


def test_decontamination_short_items_have_masks_of_their_own(spark):
    assert decontamination.sizes_of("1", decontamination.masks_for([1, 6]), [1, 6]) == [1]
    assert decontamination.sizes_of("111011", decontamination.masks_for([6, 10]), [6, 10]) == [6, 10]
    assert decontamination.sizes_of("1111", decontamination.masks_for([1]), [1]) is None
    assert decontamination.sizes_of("11", ["11"], [2]) is None  # other rules: one mask for all
    seed, text, place = np.array([7, 7, 9, 7]), np.array([0, 0, 0, 1]), np.array([5, 2, 1, 8])
    assert sorted(decontamination.first_places(seed, text, place)) == [1, 2, 3]
    # A frequent word as an item: one place of it in each document.
    d = spark.createDataFrame([(i, "the cat " * 500 + f"w{i}") for i in range(20)], "doc_id long, text string")
    b = spark.createDataFrame([(0, "The"), (1, "some item of thirteen words that no document of this small table holds anywhere")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["start_word"], r["n_words"]) for r in decontamination.contamination(d, b).collect()}
    assert got == {(i, 0, 0, 1) for i in range(20)}


BASE = [
    ("assign", re.compile("""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def test_secrets(spark):
    rnd = random.Random(7)
    bits = ["password", "=", ": ", "API_KEY", "'", '"', "AKIA", "ABCDEFGHIJ0123456", "deadbeef01234567", " ", "é", "🎉", "token", "a1b2c3d4e5f6g7h8i9j0k", "secret", "\n", "xyz_-."]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(14))) for _ in range(300)] + [""]
    data = [(i, t, f"s{i % 9}", "en") for i, t in enumerate(texts)] + [(0, texts[0], "s0", "en"), (800, None, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, lang string")
    found = secret_scan.scan_secrets(docs)
    got = found.select("doc_id", secret_scan.told("base").alias("base"), secret_scan.told("spans").alias("spans")).collect()
    assert len(got) == len(data)
    for r in got:
        text = "" if r["doc_id"] == 800 else texts[r["doc_id"]]
        spans = sorted((m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, ok) in enumerate(BASE) for m in p.finditer(text) if ok(m))
        assert r["base"] == ",".join(s for *_, s in spans)
        assert set(filter(None, r["base"].split(","))) <= set(r["spans"].split(","))
    assert secret_scan.scan_secrets(docs.limit(0)).count() == 0


def test_vector_search_is_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    x[7] = x[300]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1100, [0.0] * 16, 0), (1200, [1.0, None] * 8, 0), (1300, [float("nan")] * 16, 0), (1400, [], 0), (1500, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in vector_search.nearest(df.where("vec_id % 100 = 0"), df, query_block=2, row_block=90).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert set(got) == {0, 100, 200, 300}
    for q in got:
        d = [(float(np.sqrt(sum((a - b) ** 2 for a, b in zip(x[q], v)))), i) for i, v in enumerate(x) if i != q]  # brute force
        assert [i for _, i in got[q]] == [i for _, i in sorted(d)[:10]]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in sorted(d)[:10]])
    assert vector_search.nearest(df.limit(0), df).count() == 0
    # A row that is given twice is found twice, a query that is given twice counts once.
    twice = df.where("vec_id < 400").unionByName(df.where("vec_id IN (0, 5)"))
    found = vector_search.nearest(twice.where("vec_id = 0"), twice, k=500).where("vec_id = 5").collect()
    assert len(found) == 2 and found[0]["score"] == found[1]["score"]


def test_sentences_are_found_in_one_pass():
    import time

    def plain(text):
        """Cut by hand: after . ! ? before white space, with the blanks that follow, and after each line feed."""
        out, piece = [], ""
        for i, c in enumerate(text):
            piece += c
            blanks = piece.rstrip(" \t")
            ends = blanks[-1:] in (".", "!", "?") and (len(piece) > len(blanks) or text[i + 1 : i + 2].isspace()) and text[i + 1 : i + 2] not in (" ", "\t", "\n")
            if c == "\n" or ends:
                out.append(piece)
                piece = ""
        out += [piece] if piece else []
        merged = []
        for part in out:  # a piece without words goes with the one before
            if merged and (not part.split() or not merged[-1].split() and len(merged) > 1):
                merged[-1] += part
            else:
                merged.append(part)
        return merged

    rnd = random.Random(15)
    for _ in range(500):
        text = "".join(rnd.choice(["a", "Bc", ".", "!", "?", " ", "\n", "..."]) for _ in range(rnd.randrange(25)))
        parts = substring_dedup.sentences(text)
        assert "".join(text[a:b] for a, b, _ in parts) == text
        assert [w for _, _, words in parts for w in words] == text.lower().split()
        cut = [text[a:b] for a, b, words in parts if words]
        assert [p.split() for p in plain(text) if p.split()] == [p.split() for p in cut]
    began = time.time()
    for text in ("." * 300_000, ". " * 150_000, "a." * 150_000, "\n" * 300_000, " " * 300_000):
        assert "".join(text[a:b] for a, b, _ in substring_dedup.sentences(text)) == text
    assert time.time() - began < 20
