"""The whole corpus build: from page texts to clauses with ids, titles, references and types.

A page is worked on as one row, an array of lines. What it needs from other pages (the
section in force, the line above its first one, its number, the lines that follow it, the
headings before it) is folded over pages, one small row for each, all values in one scan
and in ranges, so that no task holds a document. Lines are shuffled once, to the clause
that they belong to, and page texts are cleaned once and written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ledgerlake.operators import corpus as C
from ledgerlake.plans.scratch import folder, stored


@dataclass(frozen=True)
class Layout:
    """How documents are laid out. These patterns decide what a heading, a banner or a sub-item is."""

    heading: str = r"^[ \t]*([0-9]+(?:\.[0-9]+)*)\.?[ \t]+(\S.{0,119}?)[ \t]*$"
    banners: tuple = (
        r"^[ \t]*SECTION[ \t]+([A-Z])[.:]?[ \t]+[A-Z][A-Za-z /&-]{2,60}[ \t]*$",
        r"^[ \t]*([IVX]{1,5})\.[ \t]+[A-Z][A-Za-z /&-]{2,60}[ \t]*$",
    )
    sub_item: str = r"^[ \t]*(?:[a-z]|[ivxlc]+|[A-Z])[.)][ \t]+"
    page_number: str = r"^(?i:page\s*)?[0-9]{1,3}(?:\s*(?i:of|/)\s*[0-9]{1,3})?$"
    definition: str = r"(?m)^[ \t]*Def\.[ \t]*([0-9]+)\.[ \t]+"
    defined: str = r"\s+(?:means|refers to|is|shall mean)\b"
    address: str = r"(?i)(?:Tel\.:|Email:|bimalokpal|cioins\.co\.in|Ombudsman)"
    code: str = r"(?i)Code[- ]?\s?Excl\s?(0?[0-9]{1,2})"
    #: Pages on which a line is furniture, as a share; the shortest body; marks that make a definitions block; marks of an address annexure.
    furniture: float = 0.5
    least_body: int = 60
    definitions: int = 5
    least_definition: int = 40
    addresses: int = 4


LAYOUT = Layout()
#: Policies (one row each) whose facts are broadcast; more are joined by a shuffle.
BROADCAST_POLICIES = 100_000


def glue(line: Column, above: Column, layout: Layout = LAYOUT) -> Column:
    """How a line of a body goes on from the one above: 'new' (on a line of its own), 'word' (a hyphen is stitched) or 'space'."""
    starts = line.rlike(layout.heading) | C.strip(line).startswith(C.TABLE) | line.rlike(layout.sub_item)
    closed = above.rlike(layout.heading) | C.strip(above).startswith(C.TABLE)
    return F.when(above.isNull() | starts | closed, "new").when(above.endswith("-"), "word").when(above.rlike(r"[.:;?!|]$"), "new").otherwise("space")


def clean_pages(pages: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """(policy, page, lines): the lines of each page that are not blank, no furniture and no page numbers; pages without any go.

    A line is furniture where it stands on max(2, floor(pages * share)) pages of its
    policy, so a policy has at most as many such lines as two or three of its pages.
    """
    cut = pages.where(F.col("policy").isNotNull() & F.col("page").isNotNull())
    cut = cut.select("policy", "page", F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.regexp_replace(x, r"\s+$", "")).alias("lines"))
    seen = cut.select("policy", F.explode(F.array_distinct(F.filter(F.transform("lines", C.strip), lambda x: x != ""))).alias("line"))
    counts = seen.groupBy("policy", "line").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    sizes = cut.groupBy("policy").agg(F.count(F.lit(1)).alias("pages"))
    repeated = counts.join(sizes.hint("merge"), "policy").where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * layout.furniture)))
    gone = stored(repeated.groupBy("policy").agg(F.collect_set("line").alias("gone")), folder(pages.sparkSession, "furniture"))
    few = gone.count() <= BROADCAST_POLICIES
    joined = cut.join(F.broadcast(gone) if few else gone.hint("merge"), "policy", "left")
    none = F.array().cast("array<string>")
    kept = F.filter("lines", lambda x: (x != "") & ~F.array_contains(F.coalesce("gone", none), C.strip(x)) & ~C.strip(x).rlike(layout.page_number))
    return joined.select("policy", "page", kept.alias("lines")).where(F.size("lines") > 0)


def before_pages(rows: DataFrame, sums: list[str], lasts: list[str]) -> DataFrame:
    """(policy, page, a column for each name): sums and last values that are not null, over all pages before each, in one scan.

    Pages are sorted into ranges; a range is folded by itself, and then the ranges of a
    policy, of which there are as many as partitions at most. Both folds combine whole
    rows of values, so one pass serves them all.
    """
    ranged = rows.select("policy", "page", *sums, *lasts).repartitionByRange("policy", "page").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, folder(rows.sparkSession, "pages"))  # a task that runs again finds the same ranges
    inner = Window.partitionBy("policy", "part").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("policy").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = [F.sum(c).alias(c) for c in sums] + [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("page"))).alias(c) for c in lasts]
    fold = lambda w, tag: [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c + tag) for c in sums] + [F.last(c, ignorenulls=True).over(w).alias(c + tag) for c in lasts]
    ranges = ranged.groupBy("policy", "part").agg(*total).select("policy", "part", *fold(outer, "__far"))
    near = ranged.select("policy", "part", "page", *fold(inner, "__near")).join(ranges.hint("merge"), ["policy", "part"])
    both = [(F.col(c + "__near") + F.col(c + "__far")).alias(c) for c in sums] + [F.coalesce(c + "__near", c + "__far").alias(c) for c in lasts]
    return near.select("policy", "page", *both)


def _banner(line: Column, layout: Layout) -> Column:
    case = F.lit(None).cast("string")
    for pattern in reversed(layout.banners):
        case = F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 1)).otherwise(case)
    return case


def _following(numbered: DataFrame) -> DataFrame:
    """(policy, number, after): the first three lines after each page, from (policy, number, first)."""
    told = numbered.select("policy", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("d"), "number", "first")
    each = told.select("policy", (F.col("number") - F.col("d")).alias("number"), F.struct("d", "first").alias("x"))
    lists = each.groupBy("policy", "number").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # three at most
    return lists.select("policy", "number", F.slice(F.flatten(F.transform("xs", lambda x: x["first"])), 1, 3).alias("after"))


def split_clauses(clean: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """(policy, clause_id, title, text, page, pos): clean pages cut at headings; bodies under the least length go with their heading."""
    spark = clean.sparkSession
    banners = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("at"), _banner(x, layout).alias("name"))), lambda b: b["name"].isNotNull())
    rows = clean.withColumn("banners", banners)
    facts = rows.select("policy", "page", F.lit(1).alias("number"), F.element_at("lines", -1).alias("above"), F.get(F.reverse("banners"), F.lit(0))["name"].alias("section"))
    before = before_pages(facts, ["number"], ["above", "section"])
    rows = rows.join(before.hint("merge"), ["policy", "page"])
    after = _following(rows.select("policy", "number", F.slice("lines", 1, 3).alias("first")))
    rows = rows.join(after.hint("merge"), ["policy", "number"], "left")
    none = F.array().cast("array<string>")
    # One row for each page, with all that it needs of the others: written, for two readers.
    rows = stored(rows.withColumn("after", F.coalesce("after", none)).drop("number"), folder(spark, "told"))

    lines = rows.select("policy", "page", "lines", "after", "banners", "section", F.posexplode("lines").alias("at", "line"))
    found = lines.where(F.col("line").rlike(layout.heading) & _banner(F.col("line"), layout).isNull())
    found = found.withColumn("raw", F.regexp_extract("line", layout.heading, 2)).where(C.looks_like_title(F.col("raw")) & ~C.is_table_debris(F.col("raw")))
    following = F.slice(F.concat(F.slice("lines", F.col("at") + 2, 3), "after"), 1, 3)
    found = C.complete_title(found.withColumn("following", following))
    own = F.get(F.reverse(F.filter("banners", lambda b: b["at"] < F.col("at"))), F.lit(0))["name"]
    heads = found.select(
        "policy", "page", "at", F.regexp_extract("line", layout.heading, 1).alias("no"), "title",
        C.fix_letter_spacing(C.strip(F.col("raw"))).alias("heading"), F.coalesce(own, "section").alias("section"),
    )
    # Written before its filter, which would else be planned with every step of the titles in it.
    heads = stored(heads, folder(spark, "heads")).where(~C.is_table_debris(F.col("title")))

    per_page = heads.groupBy("policy", "page").agg(F.array_sort(F.collect_list("at")).alias("starts"))  # the headings of one page
    counted = rows.select("policy", "page").join(per_page.hint("merge"), ["policy", "page"], "left").withColumn("n", F.coalesce(F.size("starts"), F.lit(0)))
    counted = counted.withColumn("n", F.greatest(F.col("n"), F.lit(0)))
    passed = before_pages(counted, ["n"], []).withColumnRenamed("n", "passed")
    paged = stored(counted.drop("n").join(passed.hint("merge"), ["policy", "page"]), folder(spark, "starts"))

    # Each line to its clause: the headings of the pages before, and those at or above it.
    starts = F.coalesce("starts", F.array().cast("array<int>"))
    each = rows.join(paged.hint("merge"), ["policy", "page"]).withColumn("starts", starts)
    each = each.withColumn("line", F.transform("lines", lambda x, i: F.struct(
        i.alias("at"), x.alias("line"), F.when(i > 0, F.get("lines", i - 1)).otherwise(F.col("above")).alias("above"),
        F.coalesce(F.get("lines", i + 1), F.get("after", F.lit(0))).alias("below"),
    )))
    each = each.select("policy", "page", "starts", "passed", F.explode("line").alias("x"))
    each = each.withColumn("clause", F.col("passed") + F.size(F.filter("starts", lambda s: s <= F.col("x.at"))))
    body = each.where((F.col("clause") > 0) & ~F.array_contains("starts", F.col("x.at")))
    body = body.withColumn("how", glue(F.col("x.line"), F.col("x.above"), layout)).withColumn("next", glue(F.col("x.below"), F.col("x.line"), layout))
    how, next_ = F.col("how"), F.col("next")
    left = F.when(how == "new", F.concat(F.lit("\n"), F.col("x.line"))).when(how == "space", F.concat(F.lit(" "), F.regexp_replace("x.line", r"^\s+", ""))).otherwise(F.regexp_replace("x.line", r"^\s+", ""))
    piece = F.when(F.col("x.below").isNotNull() & (next_ == "word"), F.regexp_replace(left, "-$", "")).otherwise(left)
    body = body.select("policy", "clause", F.struct("page", F.col("x.at").alias("at"), piece.alias("piece")).alias("p"))
    # A clause is one text, so the lines under one heading come together here.
    bodies = body.groupBy("policy", "clause").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "").alias("body"))
    bodies = bodies.withColumn("body", F.expr("substring(body, 2)"))

    in_page = Window.partitionBy("policy", "page").orderBy("at")
    numbered = heads.join(passed.hint("merge"), ["policy", "page"]).withColumn("clause", F.col("passed") + F.row_number().over(in_page))
    whole = numbered.join(bodies.hint("merge"), ["policy", "clause"]).where(F.length("body") >= layout.least_body)
    return whole.select(
        "policy", F.concat_ws(".", "section", "no").alias("clause_id"), F.substring("title", 1, 120).alias("title"),
        C.strip(F.concat("heading", F.lit("\n"), C.fix_letter_spacing(F.col("body")))).alias("text"), "page", F.col("clause").alias("pos"),
    )


def split_definitions(clauses: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """A clause with enough definition marks becomes one for each term, ``parent.DefN``; short ones go, and without any left it stays whole."""
    numbers = F.regexp_extract_all("text", F.lit(layout.definition), F.lit(1))
    bodies = F.transform(F.slice(F.split("text", layout.definition, -1), 2, 1_000_000), C.strip)
    pairs = F.filter(F.arrays_zip(numbers.alias("n"), bodies.alias("body")), lambda p: F.length(p["body"]) >= layout.least_definition)
    told = clauses.withColumn("n_marks", F.size(numbers)).withColumn("defs", pairs)
    told = told.withColumn("defs", F.when(F.col("n_marks") >= layout.definitions, F.col("defs")).otherwise(F.slice("defs", 1, 0)))
    whole = told.where(F.size("defs") == 0).withColumn("sub", F.lit(0)).drop("n_marks", "defs")
    each = told.where(F.size("defs") > 0).select("*", F.posexplode("defs").alias("sub", "d"))
    head = F.get(F.split("d.body", layout.defined, 2), F.lit(0))
    title = F.when(F.length(head) < 80, F.substring(C.strip(head), 1, 80)).otherwise(F.substring("d.body", 1, 60))
    each = each.select("policy", F.concat("clause_id", F.lit(".Def"), "d.n").alias("clause_id"), title.alias("title"), F.col("d.body").alias("text"), "page", "pos", "sub")
    return whole.unionByName(each)


def trim_address_blocks(clauses: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """An address annexure keeps what follows its last line with a mark, under the first plausible title there; too little of it goes."""
    block = F.regexp_count("text", F.lit(layout.address)) >= layout.addresses
    lines = F.split("text", "\n", -1)
    last = F.array_max(F.transform(lines, lambda x, i: F.when(x.rlike(layout.address), i + 1)))
    rest = C.strip(F.array_join(F.slice(lines, last + 1, F.greatest(F.size(lines) - last, F.lit(0))), "\n"))
    told = clauses.withColumn("cut", F.when(block, rest))
    plausible = F.filter(F.transform(F.split("cut", "\n", -1), C.strip), lambda x: ~x.startswith(C.TABLE) & C.looks_like_title(x) & ~C.is_table_debris(x))
    title = F.when(F.col("cut").isNotNull(), F.substring(F.coalesce(F.get(plausible, F.lit(0)), "title"), 1, 120)).otherwise(F.col("title"))
    told = told.withColumn("title", title).withColumn("text", F.coalesce("cut", "text"))
    return told.where(F.col("cut").isNull() | (F.length("cut") >= layout.least_body)).drop("cut")


def build_corpus(pages: DataFrame, labels: tuple = (), layout: Layout = LAYOUT) -> DataFrame:
    """(policy, clause_id, title, text, page, rule_type, refs, pos, sub) of all policies, from (policy, page, text).

    Furniture and page numbers are dropped, the stream of each policy's pages is cut at
    headings, ids carry the section in force, wrapped lines are joined, contents entries
    go, repeated ids keep the fullest text, definition blocks are split and address
    annexures cut, references and exclusion codes are resolved within the policy, and
    each clause gets the first type of ``labels`` (pattern, type) that matches, or
    'other'. Order is (pos, sub). Pages without a policy or number take no part; a policy
    without text has no clauses. Pages are unique by (policy, page).
    """
    spark = pages.sparkSession
    clean = stored(clean_pages(pages, layout), folder(spark, "clean"))
    clauses = C.keep_fullest(split_clauses(clean, layout))
    clauses = stored(split_definitions(clauses, layout), folder(spark, "defined"))
    clauses = stored(trim_address_blocks(clauses, layout), folder(spark, "clauses"))
    refs = C.extract_refs(clauses)
    linked = clauses.join(refs.hint("merge"), ["policy", "clause_id"], "left")
    ordered = clauses.withColumn("order", F.struct("pos", "sub"))
    codes = C.resolve_codes(ordered, layout.code, order="order")
    linked = C.append_code_refs(linked, codes)
    return C.label_rule_type(linked, labels).select("policy", "clause_id", "title", "text", "page", "rule_type", "refs", "pos", "sub")


class EmptyCorpus(ValueError):
    pass


def write_corpus(corpus: DataFrame, path: str, least_labelled: float = 0.9) -> dict:
    """Write a corpus by policy; the write itself counts clauses and labels (no job of its own).

    An empty corpus is an error, and the result tells the share of labelled clauses and
    whether it is high enough.
    """
    seen = Observation()
    labelled = F.count_if(F.col("rule_type") != "other")
    counted = corpus.observe(seen, F.count(F.lit(1)).alias("clauses"), labelled.alias("labelled"))
    counted.write.partitionBy("policy").mode("overwrite").parquet(path)
    clauses, n = seen.get["clauses"], seen.get["labelled"]
    if not clauses:
        raise EmptyCorpus(f"no clause was found; nothing is in {path}")
    return {"clauses": clauses, "labelled": n / clauses, "enough": n >= least_labelled * clauses}
