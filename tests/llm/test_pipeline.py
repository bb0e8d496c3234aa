"""The pipeline on a small corpus with planted cases."""

import base64
import random

import numpy as np
import public_tokenizers as P

import corpus_pipeline

SYLLABLES = ["ka", "lo", "mi", "ren", "tu", "ses", "vo", "dan", "pir", "quo", "ble", "sha", "ning"]
INSULTS = ["moronic", "worthless", "disgusting", "pathetic"]


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_planted_cases(spark, tmp_path):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randrange(2, 5)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(20)) for _ in range(n))
    items = [" ".join(word() for _ in range(30)) for _ in range(4)]
    docs, labels, clean, toxic, leaked = [], [], [], [], []
    for i in range(300):
        body = text(6)
        if i % 5 == 1:
            words = body.split(" ")
            for _ in range(12):
                words[rnd.randrange(len(words))] = rnd.choice(INSULTS)
            body = " ".join(words)
            toxic.append(i)
        elif i % 25 == 2:
            body = body + "\n" + items[i % 4] + "\n" + text(2)
            leaked.append(i)
        else:
            clean.append(i)
        docs.append((i, body))
        labels.append((i, 1, int(i % 5 == 1)))
    boiler = " ".join(word() for _ in range(12))
    docs = [(i, t + "\n" + boiler) for i, t in docs]
    copies = [(1000 + k, docs[clean[k]][1]) for k in range(20)]  # all their lines go, and so do they
    # The same words in other lines: no line matches, so only near_dedup can tell them.
    reflowed = []
    for k in range(20):
        words = docs[clean[30 + k]][1].rsplit("\n", 1)[0].split()
        reflowed.append((2000 + k, " ".join(words[:10]) + "\n" + "\n".join(" ".join(words[i : i + 20]) for i in range(10, len(words), 20)) + "\n" + boiler))
    odd = [(5000, None), (5001, "")]
    rows = [(i, t, "en", "s0", len(t or "")) for i, t in [*docs, *copies, *reflowed, *odd]]
    write(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    write(spark, tmp_path, "labels", labels, "doc_id long, quality int, toxic int")
    write(spark, tmp_path, "benchmark", list(enumerate(items)), "item_id long, text string")

    kept, frame = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = frame.columns
        path = f"{tmp_path}/stage-{name}"
        stage(spark, frame, str(tmp_path)).write.parquet(path)
        frame = spark.read.parquet(path)
        kept[name] = {r[0] for r in frame.select("doc_id").collect()}
        assert frame.columns == before or name == "byte_bpe"
        if name == "line_dedup":
            texts = {r["doc_id"]: r["text"] for r in frame.collect()}
            with_boiler = [i for i in texts if texts[i] and boiler in texts[i]]
            assert with_boiler == [min(kept["toxicity"] - {5000, 5001})]
            assert all(r["text"] or r["doc_id"] in (5000, 5001) for r in frame.collect())
        if name == "decontamination":
            final = {r["doc_id"]: r["text"] for r in frame.collect()}
    ids = {i for i, _ in [*docs, *copies, *reflowed, *odd]}
    gone = ids - kept["toxicity"]
    assert len(gone & set(toxic)) >= 0.95 * len(toxic) and len(gone - set(toxic)) <= 3
    assert kept["line_dedup"] == kept["toxicity"] - {i for i, _ in copies}
    found = {i for i, _ in reflowed} & kept["toxicity"]
    assert len(found) > 15 and kept["near_dedup"] == kept["line_dedup"] - {i for i in found if clean[30 + i - 2000] in kept["toxicity"]}
    assert kept["near_dedup"] - kept["decontamination"] == set(leaked) & kept["toxicity"] - {i for i in leaked if items[i % 4] not in (texts[i] or "")}
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in frame.collect():
        assert bytes(r["ids"]) == np.array(library.encode_ordinary(final[r["doc_id"]] or ""), dtype="<u4").tobytes()


def test_one_of_each_group_of_copies_stays(spark, tmp_path):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice(SYLLABLES) + rnd.choice(SYLLABLES) + str(rnd.randrange(40)) for _ in range(60)) for _ in range(5)]
    rows = [(i, base[i % 5] + (" tail" if i > 9 else ""), "en", "s", 1) for i in range(20)] + [(3, base[3], "en", "s", 1), (None, base[0], "en", "s", 1), (4, "quite another text of seven words here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got.select("doc_id").collect() if r["doc_id"] is not None) == [(False, i) for i in (0, 1, 2, 3, 4, 4)]
    assert got.where("doc_id IS NULL").count() == 1


def test_columns_of_any_name_come_back(spark, tmp_path):
    rnd = random.Random(4)
    text = lambda: " ".join(rnd.choice(SYLLABLES) + rnd.choice(SYLLABLES) for _ in range(30))
    names = ["score", "mean_gain", "max_gain", "__row", "n_lines", "n_removed", "decoded", "id", "count", "kept", "component_id", "__column", "item_id", "a.b"]
    rows = [(i, text(), *[i * 100 + k for k in range(len(names))]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names))
    write(spark, tmp_path, "labels", [(i, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    write(spark, tmp_path, "benchmark", [(1, "quite other words than those of any text above")], "item_id long, text string")
    for name, stage in corpus_pipeline.STAGES[1:]:
        got = stage(spark, docs, str(tmp_path))
        if name != "byte_bpe":
            assert got.columns == docs.columns
            assert sorted(map(tuple, got.collect())) == rows
        else:
            assert got.count() == 12
    toxic = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert toxic.columns == docs.columns and set(map(tuple, toxic.collect())) <= set(rows)


def test_empty_tables_and_long_texts_go_through(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    write(spark, tmp_path, "labels", [(1, 1, 0)], "doc_id long, quality int, toxic int")
    write(spark, tmp_path, "benchmark", [(1, "some words of an item")], "item_id long, text string")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
