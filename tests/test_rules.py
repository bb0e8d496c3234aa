"""Unit cases of the rules, with the amounts that they must give."""

import random

from pyspark.sql import functions as F

from ledgerlake.functions import text as T
from ledgerlake.operators import adjudicate as A
from ledgerlake.operators import clause_rules as K
from ledgerlake.operators import corpus as C
from ledgerlake.operators import intake as I
from ledgerlake.operators import memo as M
from ledgerlake.operators import retrieval as R
from ledgerlake.operators.rules import not_payable_list
from ledgerlake.plans.q_retrieval import holding
from ledgerlake.sources import files as S

LINE = "bill_id long, policy string, line_no int, item string, cents long, qty int, sum_insured long, per_day long, allowed long, over_limit boolean"


def lines(spark, *rows):
    return spark.createDataFrame(list(rows), LINE)


def with_limit(spark, cents, qty, *limits):
    df = spark.createDataFrame([(cents, qty, 500000)], "cents long, qty int, sum_insured long")
    text = ", ".join(f"named_struct('amount', {a}, 'percentage', {p}, 'basis', '{b}')" for a, p, b in limits)
    r = A.allowed_amount(df.withColumn("limits", F.expr(f"CAST(array({text}) AS {A.LIMITS})"))).first()
    return r["allowed"], r["over_limit"]


def test_limits(spark):
    assert with_limit(spark, 4000000, 5, ("500000L", "NULL", "per_day")) == (2500000, True)
    assert with_limit(spark, 2500000, 5, ("500000L", "NULL", "per_day")) == (2500000, False)
    assert with_limit(spark, 4000000, 1, ("3000000L", "NULL", "total"), ("NULL", "5", "total")) == (2500000, False)
    assert with_limit(spark, 4000000, 1) == (4000000, False)


def test_second_pass_ratio(spark):
    df = lines(
        spark,
        (1, "p", 1, "big gear", 800000, 1, 1, 500000, 500000, True), (1, "p", 2, "red widget", 10000000, 1, 1, None, 10000000, False),
        (1, "p", 3, "red gizmo", 100, 1, 1, None, 100, False), (2, "p", 1, "red widget", 77, 1, 1, None, 77, False), (1, "p", 4, "x ring", 50, 1, 1, None, None, False),
    )
    got = {(r["bill_id"], r["line_no"]): r["allowed"] for r in A.second_pass(df, stated(spark)).collect()}
    assert got == {(1, 1): 500000, (1, 2): 6250000, (1, 3): 100, (2, 1): 77, (1, 4): None}


def stated(spark, policy="p"):
    return spark.createDataFrame([(policy, "C.7")], "policy string, clause_id string")


def test_second_pass_cites_a_clause_or_deducts_nothing(spark):
    df = lines(
        spark,
        (1, "p", 1, "big gear", 800000, 1, 1, 500000, 500000, True), (1, "p", 2, "red widget", 1000, 1, 1, None, 1000, False), (1, "p", 3, "red gizmo", 100, 1, 1, None, 100, False),
        (1, "p", 4, "x plate", 50, 1, 1, None, 50, False), (2, "p", 1, "red widget", 800, 1, 1, 100, 100, True), (2, "p", 2, "x ring", 70, 1, 1, None, 70, False),
    )
    told = lambda out: {(r["bill_id"], r["line_no"]): (r["allowed"], r["deduction"], r["why"]) for r in out.collect()}
    got = told(A.second_pass(df, stated(spark)))
    assert got[1, 2] == (625, "C.7", None)
    assert got[1, 1][2] == "the room line itself" and got[1, 3][2] == "outside the associated expenses" and got[1, 4][2] == "not named by the definition"
    # A breach on a line that is no room sets no ratio.
    assert got[2, 2] == (70, None, "no per-day cap was breached")
    assert told(A.second_pass(df, stated(spark, "other")))[1, 2] == (1000, None, "no clause states the deduction")
    assert told(A.second_pass(df, stated(spark), differential_billing=False))[1, 2] == (1000, None, "differential billing was ruled out")


def test_named_benefits_stay_open_and_equal_lines_stay_apart(spark):
    row = (1, "p", 1, "red bolt", 100, 1, 1, None, None, False)
    df = lines(spark, row, row, (1, "p", 2, "SMALL ANVIL (x)", 5, 1, 1, None, None, False), (1, "p", 3, "xyz", 5, 1, 1, None, None, False)).drop("allowed")
    got = sorted((r["line_no"], r["list_no"], r["allowed"]) for r in A.non_payable_match(df, not_payable_list(spark)).collect())
    assert got == [(1, None, None), (1, None, None), (2, 1, 0), (3, None, None)]
    got = sorted((r["line_no"], r["list_no"] or 0) for r in A.non_payable_longest(df, not_payable_list(spark)).collect())
    assert got == [(1, 4), (1, 4), (2, 2), (3, 0)]


def test_holding_finds_short_and_cut_quotes(spark):
    texts = spark.createDataFrame([("p", 1, "one two three four five six seven"), ("p", 2, "xone two\nthree four five six"), ("q", 3, "lone word"), ("q", 3, "lone word")], "policy string, clause_id long, text string")
    quotes = ["two three four five six", "ne two three four fiv", "on", "word", "one two\nthree", "seven eight nine ten eleven twelve"]
    asked = spark.createDataFrame(list(enumerate(quotes)), "query_id int, q string")
    got = sorted((r["clause_id"], r["query_id"]) for r in holding(texts, asked, "q").collect())
    want = sorted((t["clause_id"], i) for t in texts.collect() for i, q in enumerate(quotes) if q in t["text"])
    assert got == want


def test_months_served(spark):
    df = spark.createDataFrame([("2024-01-31", "2024-02-29"), ("2024-01-15", "2025-01-14"), ("2024-01-15", "2025-01-15")], "a string, b string")
    got = [r[0] for r in df.select(A.months_served("to_date(a)", "to_date(b)")).collect()]
    assert got == [0, 11, 12]


def test_open_lines_never_count_as_zero(spark):
    df = lines(spark, (1, "p", 1, "a", 100, 1, 1, None, None, False), (1, "p", 2, "b", 50, 1, 1, None, 0, False))
    r = A.report(df).first()
    assert (r["charged"], r["allowed"], r["flagged"]) == (150, 0, 1)


def test_readers(spark):
    text = "Bill No: 7\nTotal Knee Replacement   1   1,000.00\nPin code 400 001\nWard 8,000 x 5 days   5   40,000.00\nSub total   41,000.00\nGRAND TOTAL   41,000.00"
    df = spark.createDataFrame([(7, text)], "bill_id long, text string")
    shy = [(r["item"], r["cents"]) for r in I.read_charges_shy(df).orderBy("pos").collect()]
    assert shy == [("Total Knee Replacement", 100000), ("Ward 8,000 x 5 days", 4000000)]
    printed = [(r["item"], r["qty"], r["cents"]) for r in I.read_printed_rows(df).orderBy("line_no").collect()]
    assert printed == [("Total Knee Replacement", 1, 100000), ("Ward 8,000 x 5 days", 5, 4000000)]


def test_masks(spark):
    df = spark.createDataFrame([("Claim No. - 77\n UHID: x1\nName: Jo Doe\nmail a.b@c.org tel +1 (555) 555-1234 id 1234 5678 9012",)], "t string")
    out = df.select(T.mask(F.col("t"))).first()[0]
    assert out == "Claim No. - [REDACTED]\n UHID: [REDACTED]\nName: [REDACTED]\nmail [REDACTED] tel [REDACTED] id [REDACTED]"
    assert not df.select(T.has_identifier(T.mask(F.col("t")))).first()[0]


def test_windows_overlap_by_one_sentence(spark):
    text = "aaaa. bbbb. cccc. dddd."
    out = spark.createDataFrame([(text,)], "t string").select(R.sentence_windows(F.col("t"), 10)).first()[0]
    assert out == ["aaaa. bbbb.", "bbbb. cccc.", "cccc. dddd."]


def test_result_does_not_depend_on_partitions(spark):
    rnd = random.Random(1)
    rows = [(i % 9, "p", i, rnd.choice(["x gear", "x widget", "x gizmo"]), rnd.randrange(1, 9999), 1, 1, 50, rnd.randrange(1, 99), rnd.random() < 0.3) for i in range(200)]
    a = A.second_pass(lines(spark, *rows), stated(spark)).collect()
    rnd.shuffle(rows)
    b = A.second_pass(lines(spark, *rows).repartition(7), stated(spark)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_text_files(spark, tmp_path):
    (tmp_path / "bills").mkdir()
    (tmp_path / "bills/a.txt").write_text("one\ntwo")
    (tmp_path / "bills/b.txt").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "bills/c.txt").write_bytes(b"\xff\xfe\x00")
    got = {r["path"][-5:]: (r["text"], r["refused"]) for r in S.read_text_bills(spark, str(tmp_path / "bills")).collect()}
    assert got == {"a.txt": ("one\ntwo", None), "b.txt": (None, "pdf"), "c.txt": (None, "not utf-8")}
    (tmp_path / "My Policy-2.txt").write_text("p1\fp2")
    pages = [tuple(r) for r in S.read_pages(spark, str(tmp_path / "My Policy-2.txt")).orderBy("page").collect()]
    assert pages == [("my_policy_2", 1, "p1"), ("my_policy_2", 2, "p2")]
    (tmp_path / "new.json").write_text('[{"no": 5, "item": "soap"}, {"item": "towel"}]')
    (tmp_path / "old.json").write_text('["soap", "towel"]')
    assert [tuple(r) for r in S.read_exclusion_list(spark, str(tmp_path / "new.json")).collect()] == [(5, "soap"), (2, "towel")]
    assert [tuple(r) for r in S.read_exclusion_list(spark, str(tmp_path / "old.json")).collect()] == [(1, "soap"), (2, "towel")]


def test_memo_computes_unknown_rows_only(spark):
    df = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    compute = lambda x: x.select("key", "a", (F.col("a") + F.col("b")).alias("c"))
    first, fresh = M.memoise(df.limit(1), None, ["a", "b"], compute, F.lit(True))
    done, more = M.memoise(df, fresh.withColumn("c", F.lit(99)), ["a", "b"], compute, F.lit(True))
    assert sorted((r["a"], r["c"]) for r in done.collect()) == [(1, 99), (3, 7)] and more.count() == 1


def test_pages_are_folded_over_several_ranges(spark):
    rows = [(f"p{i % 3}", i, None if i % 4 else i) for i in range(300)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pages = spark.createDataFrame(rows, "policy string, page int, v long")
        last = {(r["policy"], r["page"]): r["before"] for r in C.earlier_pages(pages, "last").collect()}
        sums = {(r["policy"], r["page"]): r["before"] for r in C.earlier_pages(pages.fillna(1, "v"), "sum").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for policy, page, _ in rows:
        above = [v for p, n, v in rows if p == policy and n < page]
        assert last[policy, page] == next((v for v in reversed(above) if v is not None), None)
        assert sums[policy, page] == sum(1 if v is None else v for v in above)


def test_lines_are_numbered_and_carried_over_pages(spark):
    text = [("a", 1, "One.\nx"), ("a", 2, ""), ("a", 3, "y\nTwo.\nz"), ("b", 1, None), ("b", 2, "q")]
    lines = C.page_lines(spark.createDataFrame(text, "policy string, page int, text string"))
    got = [tuple(r) for r in C.section_carry(lines, r"^[A-Z].*\.$").orderBy("policy", "seq").select("policy", "seq", "line", "section").collect()]
    assert got == [("a", 1, "One.", "One."), ("a", 2, "x", "One."), ("a", 3, "", "One."), ("a", 4, "y", "One."), ("a", 5, "Two.", "Two."), ("a", 6, "z", "Two."), ("b", 1, "q", None)]


def test_missing_numbers_of_a_list_are_the_next_free_ones(spark):
    rows = [(1, 1, "soap"), (2, None, "towel"), (3, 2, "gown"), (4, None, "  cap "), (5, None, "SOAP"), (6, 5, "comb"), (7, None, "ab"), (8, None, "mask"), (9, None, "item")]
    df = spark.createDataFrame([(k, *r) for k in (1, 2) for r in rows], "list int, pos int, no int, item string")
    want = [(1, "soap"), (3, "towel"), (2, "gown"), (4, "cap"), (5, "comb"), (6, "mask")]
    assert sorted(map(tuple, K.parse_exclusion_pairs(df).collect())) == sorted((k, *w) for k in (1, 2) for w in want)


def test_equal_clause_ids_of_two_policies_stay_apart(spark):
    hits = spark.createDataFrame([(1, "a", 7, 5, 1), (2, "b", 7, 4, 1)], "query_id long, policy string, clause_id long, score long, rank int")
    refs = spark.createDataFrame([("a", 7, [8]), ("b", 7, [9])], "policy string, clause_id long, refs array<long>")
    got = R.follow_refs(hits, refs)
    assert sorted((r["query_id"], r["clause_id"]) for r in got.collect()) == [(1, 7), (1, 8), (2, 7), (2, 9)]
    clauses = spark.createDataFrame([("a", 7), ("a", 9), ("b", 7), ("b", 9)], "policy string, clause_id long")
    assert sorted((r["query_id"], r["clause_id"]) for r in R.drop_unknown(got, clauses).collect()) == [(1, 7), (2, 7), (2, 9)]


def test_waiting_period_is_the_shortest_clause_that_states_a_number(spark):
    rows = [("p", "a", "Excl01 and Excl02: 12, 24 months or 36 months, with more words"), ("p", "b", "Excl02"), ("p", "c", "Code Excl-03: 30 days"), ("q", "d", "no code, 24 months")]
    got = {(r["kind"]): (r["clause_id"], r["months"], r["days"]) for r in K.waiting_periods(spark.createDataFrame(rows, "policy string, clause_id string, text string")).collect()}
    assert got == {"ped": ("a", 36, None), "specified": ("a", 24, None), "initial": ("c", None, 30)}


def test_code_references_follow_document_order_and_leave_out_the_clause_itself(spark):
    rows = [("p", "z", 1, "Code Excl 01: first", ["x"]), ("p", "a", 2, "Code Excl01: second", None), ("p", "m", 3, "see Exclusion No. 1 and Code-Excl 9", ["z", "y"])]
    df = spark.createDataFrame(rows, "policy string, clause_id string, pos int, text string, refs array<string>")
    codes = C.resolve_codes(df, r"Code[- ]?\s?Excl\s?(0?[0-9]{1,2})", order="pos")
    got = {r["clause_id"]: r["refs"] for r in C.append_code_refs(df, codes).collect()}
    assert got == {"z": ["x"], "a": ["z"], "m": ["z", "y"]}


def test_references_expand_lists_and_count_once(spark):
    rows = [("p", "C.2", "Coverages II.1, II.2 and II.1 of Section C-2, Section A 3 and clause 4.1"), ("p", "II.1", ""), ("p", "II.2", None), ("p", "A.3", ""), ("q", "4.1", "")]
    got = C.extract_refs(spark.createDataFrame(rows, "policy string, clause_id string, text string")).collect()
    assert [(r["clause_id"], r["refs"]) for r in got] == [("C.2", ["A.3", "II.1", "II.2"])]


def test_a_lost_page_is_found_and_a_moved_one_is_not(spark):
    page = "The quick brown fox jumps over the lazy dog, 12 times a day"
    clauses = spark.createDataFrame([("p", "x: " + page.upper().replace(" ", "\n")), ("p", ""), ("p", None)], "policy string, text string")
    probe = "thequickbrownfoxjumpsoverthela"
    probes = spark.createDataFrame([("p", 1, probe), ("q", 1, probe), ("p", 2, probe[::-1])], "policy string, page int, probe string")
    for few in (10, 0):
        assert sorted(map(tuple, C.lost_pages(clauses, probes, few=few).collect())) == [("p", 2), ("q", 1)]


def test_windows_carry_the_title(spark):
    text = " ".join(f"Sentence number {i} of this long clause." for i in range(60))
    df = spark.createDataFrame([("p", 1, text, "Room rent"), ("p", 2, "short", "Other"), ("p", 3, text, None)], "policy string, clause_id int, text string, title string")
    got = R.sub_chunk(df).collect()
    assert [r["text"] for r in got if r["clause_id"] == 2] == ["short"]
    assert all(r["text"].startswith("Room rent\nSentence") for r in got if r["clause_id"] == 1)
    assert all(r["text"].startswith("Sentence") for r in got if r["clause_id"] == 3)
