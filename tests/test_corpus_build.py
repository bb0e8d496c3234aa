"""The whole corpus build on small documents, and the rules it is made of, case by case."""

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import text as T
from ledgerlake.operators import corpus as C
from ledgerlake.operators import corpus_build as B

LONG = "of all that is needed in hospital, as agreed and as set out in the schedule of this policy"
PAGES = [
    ("p", 1, "ACME Policy\nSECTION B Cover rules\n1. Room Rent\nWe pay the room up to the sum and for the per-\niod of stay that is named\n a) first item here\nb) second\nPage 1 of 3"),
    ("p", 2, f"ACME Policy\nand more of it, which is long enough to count as a body text.\n2.1 In-patient Treatment: We will cover the\ncost\n[table] Sum 1 - Limit 2\n{LONG} in Section B.1 below\n2"),
    ("p", 3, "ACME Policy\nII. Exclusions\n3. Waiting periods of the\nkind named here and Code Excl 01 of the list for thirty days from the first start of it\n500 mg 2 3\n"),
    ("p", 4, f"ACME Policy\n4. Terms\n" + "\n".join(f"Def. {i}. Term{i} means {LONG}." if i != 3 else "Def. 3. Short means x." for i in range(1, 7))),
    ("p", 5, f"ACME Policy\n5. Offices\nOmbudsman Tel.: 1\nOmbudsman Email: x.\nBenefits that remain:\n{LONG}, see Exclusion No. 1\n6. Contents\n7 Contents too"),
    ("q", 1, f"1. Room Rent\n{LONG}, short\n1. Room Rent\n{LONG}, longer text wins"),
    (None, 1, "1. Lost\n" + LONG), ("r", 1, None),
]


@pytest.fixture(scope="module")
def built(spark):
    pages = spark.createDataFrame(PAGES, "policy string, page int, text string")
    rows = B.build_corpus(pages, (("Code Excl", "waiting"), ("means", "definition"))).orderBy("policy", "pos", "sub").collect()
    return {(r["policy"], r["clause_id"]): r for r in rows}


def test_ids_carry_the_section_in_force(built):
    assert list(built) == [("p", k) for k in ("B.1", "B.2.1", "II.3", "II.4.Def1", "II.4.Def2", "II.4.Def4", "II.4.Def5", "II.4.Def6", "II.5")] + [("q", "1")]


def test_a_clause_goes_over_a_page_break_and_wrapped_lines_are_joined(built):
    want = "Room Rent\nWe pay the room up to the sum and for the period of stay that is named\n a) first item here\nb) second and more of it, which is long enough to count as a body text."
    assert (built["p", "B.1"]["text"], built["p", "B.1"]["page"]) == (want, 1)
    # The banner that ends a section stays in the body above it, tables stand by themselves.
    lines = built["p", "B.2.1"]["text"].split("\n")
    assert lines[:3] == ["In-patient Treatment: We will cover the", "cost", "[table] Sum 1 - Limit 2"] and lines[3].endswith("below II. Exclusions")


def test_titles_end_at_a_colon_or_go_on_over_the_lines_below(built):
    assert built["p", "B.2.1"]["title"] == "In-patient Treatment"
    assert built["p", "II.3"]["title"] == "Waiting periods of the kind named here and Code Excl 01 of the list for thirty days from"


def test_definitions_addresses_contents_and_repeats(built):
    assert built["p", "II.4.Def2"]["title"] == "Term2" and built["p", "II.4.Def2"]["text"] == f"Term2 means {LONG}."
    assert built["p", "II.5"]["title"] == "Benefits that remain:" and "Ombudsman" not in built["p", "II.5"]["text"]
    assert built["q", "1"]["text"].endswith("longer text wins")


def test_references_codes_and_types(built):
    assert built["p", "B.2.1"]["refs"] == ["B.1"]
    assert built["p", "II.5"]["refs"] == ["II.3"]  # exclusion no. 1 is the clause that carries code 01
    assert [built["p", k]["rule_type"] for k in ("II.3", "II.4.Def1", "B.1")] == ["waiting", "definition", "other"]


def test_a_write_counts_what_it_writes(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[5:6], "policy string, page int, text string")
    assert B.write_corpus(B.build_corpus(pages), str(tmp_path / "c")) == {"clauses": 1, "labelled": 0.0, "enough": False}
    assert B.write_corpus(B.build_corpus(pages, (("longer", "x"),)), str(tmp_path / "d"))["enough"]
    with pytest.raises(B.EmptyCorpus):
        B.write_corpus(B.build_corpus(pages.limit(0)), str(tmp_path / "e"))


def told(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_a_drop_capital_is_joined_at_the_start_only(spark):
    assert told(spark, C.fix_letter_spacing, "O rgan", "A YUSH", "A day", "Plan B is open", "I ncome", "V II") == ["Organ", "AYUSH", "A day", "Plan B is open", "I ncome", "VII"]


def test_debris_of_tables(spark):
    assert told(spark, C.is_table_debris, "GAUZE 16 X-RAY FILM", "Up to 3000 0% 0%", "500/- per day", "", "Room Rent", "[table] x", "Rs 1") == [True, True, True, True, False, True, True]


@pytest.mark.parametrize("text", ["call 9876543210 now", "+91 9876543210", "91-9876543210", "1234 5678 9012", "a.b+c@mail.org"])
def test_plain_phone_numbers_and_other_identifiers_are_masked(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(T.mask(F.col("t")).alias("m"), T.has_identifier(F.col("t")).alias("h")).select("m", "h", T.has_identifier(F.col("m")).alias("left")).first()
    assert "[REDACTED]" in got["m"] and got["h"] and not got["left"]


def test_other_numbers_stay(spark):
    assert told(spark, T.has_identifier, "1234567890", "98765", "19876543210 5", "98765432101") == [False] * 4


def test_lines_of_pages_without_a_policy_are_kept(spark):
    pages = spark.createDataFrame([("p", 1, "a\nb"), ("p", None, "c"), (None, 1, "d")], "policy string, page int, text string")
    rows = C.page_lines(pages).collect()
    assert sorted((r["line"], r["seq"]) for r in rows) == [("a", 2), ("b", 3), ("c", 1), ("d", 1)]


def test_limits_are_read_by_their_wording(spark):
    from ledgerlake.operators.judging import limits_in

    texts = (
        "Up to 5% of the sum insured or Rs 2,00,000 per day from 2024", "up to Rs.750/- per hospitalization and up to Rs.1,500/- per Policy Period",
        "10% of Sum Insured or INR 1,00,000, whichever is less", "pin 400001, 36 months, 12.5% of the sum insured", "₹ 1,200.50 daily",
    )
    got = [[tuple(x) for x in r] for r in told(spark, limits_in, *texts)]
    assert got == [
        [(None, 5, "total"), (20_000_000, None, "per_day")], [(75_000, None, "total"), (150_000, None, "total")],
        [(None, 10, "total"), (10_000_000, None, "total")], [], [(120_050, None, "per_day")],
    ]
