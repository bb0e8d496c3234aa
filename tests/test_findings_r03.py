"""Cases of the third round of findings, on tables of a few rows."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import corpus as C
from ledgerlake.operators import grid as T
from ledgerlake.operators import locate as L
from ledgerlake.operators import retrieval as R
from ledgerlake.plans import registry
from ledgerlake.plans import sql_text as S


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL over small tables, each given as a SELECT of DuckDB."""
    con = duckdb.connect()
    for table, select in tables.items():
        con.execute(f"COPY ({select}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = registry.queries()[name](spark, str(folder))
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.select(*columns).collect()), key=repr), sorted(want, key=repr)


@pytest.mark.parametrize("text, want", [("E INÖ!!", "E INÖ!!"), ("E IN!!", "EIN!!"), ("E IN", "EIN"), ("E\x0bIN_", "E\x0bIN_"), ("E\x0bIN,", "EIN,"), ("D iö", "D iö"), ("D ief", "Dief")])
def test_a_word_of_capitals_ends_by_the_letters_of_all_scripts(spark, text, want):
    assert spark.range(1).select(C.fix_letter_spacing(F.lit(text))).first()[0] == want
    assert duckdb.execute(f"SELECT {S.cap('t')} FROM (SELECT ? AS t)", [text]).fetchall() == [(want,)]


def test_a_share_of_the_sum_insured_limits_in_the_sql_as_well(spark, tmp_path):
    docs = "SELECT i AS doc_id, 'src' || (i % 20) AS source, 'en' AS lang, 'alpha beta gamma' AS text FROM range(60, 62) t(i)"
    items = "SELECT i AS item_id, 'alpha beta gamma' AS text FROM range(20, 22) t(i)"
    got, want = both(spark, tmp_path, "naive_audit", documents=docs, benchmark=items)
    assert got == want
    assert {r[1]: r[0] for r in got} == {20: 500_000, 21: 75_050}


def test_words_that_nobody_asks_for_stay_with_their_text(spark, monkeypatch):
    written = {}

    def keep(df, path):
        written[path.rsplit("/", 1)[-1].rsplit("-", 1)[0]] = df.cache()
        return df

    monkeypatch.setattr(R, "stored", keep)
    clauses = spark.createDataFrame([("p", 1, "room rent room"), ("p", 2, "rent of boats"), ("q", 3, "room"), ("p", 4, None)], "policy string, clause_id int, text string")
    asked = spark.createDataFrame([(1, "p", "Room, rent"), (2, "q", "boats")], "query_id int, policy string, text string")
    got = {(r["query_id"], r["clause_id"]): r["score"] for r in R.bm25(asked, clauses).collect()}
    held = {(r["policy"], r["clause_id"], r["dl"]): sorted(map(tuple, r["terms"])) for r in written["terms"].collect()}
    assert held == {("p", 1, 3): [("rent", 1), ("room", 2)], ("p", 2, 3): [("rent", 1)]}
    weight = lambda tf, df: math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2)
    assert got == {(1, 1): pytest.approx(weight(2, 1) + weight(1, 2)), (1, 2): pytest.approx(weight(1, 2))}


def test_a_cell_of_a_common_table_stands_in_one_column_of_tiles(spark):
    wide = spark.range(1).select((T._tile(F.lit(300.0), 0) - T._tile(F.lit(0.0), 0)).alias("n"))
    assert wide.first()["n"] == 0
    # A cell over the edge of a tile, both ways, still holds its words.
    words = spark.createDataFrame([(1, 1, 1000.0, 1010.0, 60.0, 64.0, "a"), (1, 1, 1100.0, 1110.0, 70.0, 74.0, "b")], "doc int, page int, x0 double, x1 double, top double, bottom double, word string")
    cells = spark.createDataFrame([(1, 1, 7, 990.0, 1200.0, 50.0, 90.0)], "doc int, page int, cell int, cx0 double, cx1 double, cy0 double, cy1 double")
    assert [tuple(r) for r in T.words_to_cells(words, cells).collect()] == [(1, 1, 7, "a b")]


def test_texts_are_shuffled_once_and_equal_quotes_are_asked_once(spark, monkeypatch):
    written = {}

    def keep(df, path):
        name = path.rsplit("/", 1)[-1].rsplit("-", 1)[0]
        written.setdefault(name, []).append(df.count())
        return df.localCheckpoint()

    monkeypatch.setattr(L, "stored", keep)
    long = "a b c d e f g h i j"
    texts = spark.createDataFrame([("p", long + " k l"), ("p", "x b c y"), ("q", long)] + [("p", f"a b c d {i}") for i in range(9)], "policy string, text string")
    asked = spark.createDataFrame([(1, "p", long + " zz"), (2, "p", long + " zz"), (3, "p", "a b c d q"), (4, "p", "x b"), (5, None, "x"), (6, "p", None), (7, "q", "j zz")], "quote_id int, policy string, quote string")
    got = {r["quote_id"]: (r["words"], r["total"]) for r in L.longest_support(texts, asked).collect()}
    assert got == {1: (10, 11), 2: (10, 11), 3: (4, 5), 4: (2, 2), 5: (0, 1), 6: (0, 0), 7: (1, 2)}
    assert written["hits"] == [1, 10]  # starts of eight words have one place; only the quote that has none meets the common start
