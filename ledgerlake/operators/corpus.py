"""Building the clause corpus: page text to lines, headings, clauses, references and tables.

Most stages look back along the lines of a document: gaps and islands, all documents in
one job. ``policy`` names a document, ``page`` its pages and ``seq`` the order of its
lines. Each page is worked on by itself; what comes over from the pages before is
folded apart, from one row for each page, so that no task holds a whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.plans.scratch import folder, stored

HEADING = r"^[ \t]*([0-9]+(?:\.[0-9]+)*)\.?[ \t]+(\S.*?)[ \t]*$"
TABLE = "[table]"
# Words on which a title does not end.
FUNCTION_WORDS = (
    r"(?i)\b(the|a|an|of|for|in|to|and|or|is|are|be|with|by|from|as|at|on|which|that|will|shall|any|all|this|these|its|our|we|you|if|under|upto|up)$"
)
# How policies name a clause. (mention, one id in it), in the order in which references are listed.
REF_SHAPES = (
    (r"\bSection\s+([A-E][.\- ]\s?[0-9]+(?:\.[0-9]+)*)", r".+"),
    (r"\bCoverages?\s+((?:[IVX]+\.[0-9]+(?:\.[0-9]+)*\s*,?\s*(?:and\s+)?)+)", r"[IVX]+\.[0-9]+(?:\.[0-9]+)*"),
    (r"\b[Cc]lause\s+([0-9]+(?:\.[0-9]+)+)", r".+"),
    (r"\bExclusions?\s+[Nn]o\.?\s*([0-9]+)", r".+"),
)
#: What parts the letter of a section from its number.
SECTION_GAP = r"^([A-E])[.\- ]\s?"
CODE_MENTION = r"(?:\bExclusions?\s+[Nn]o\.?\s*|(?i:Code[- ]?\s?Excl\s?))(0?[0-9]{1,2})"
#: A limit that reads as an entitlement to a room: money for each day, or a category.
ROOM_LIMIT = r"(?i)([0-9][0-9,]*\s*/?-?\s*per\s*day|[a-z][a-z/ .]*room)"


def earlier_pages(pages: DataFrame, how: str) -> DataFrame:
    """(policy, page, before) of (policy, page, v), a row for each page: the sum, or the last value that is not null, of the pages before.

    Pages are sorted into ranges; each range is folded by itself and then the ranges of
    a policy, of which there are as many as partitions at most. The ranges are written,
    so that a task that runs again finds the same ones.
    """
    rows = pages.repartitionByRange("policy", "page").withColumn("part", F.spark_partition_id())
    rows = stored(rows, folder(pages.sparkSession, "pages"))
    inner = Window.partitionBy("policy", "part").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("policy").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    if how == "sum":
        whole, over = F.sum("v"), lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    else:
        whole, over = F.max_by("v", F.when(F.col("v").isNotNull(), F.col("page"))), lambda c, w: F.last(c, ignorenulls=True).over(w)
    ranges = rows.groupBy("policy", "part").agg(whole.alias("v"))
    ranges = ranges.select("policy", "part", over("v", outer).alias("far"))
    near = rows.select("policy", "part", "page", over("v", inner).alias("near"))
    both = F.col("near") + F.col("far") if how == "sum" else F.coalesce("near", "far")
    ranges = ranges.withColumnsRenamed({"policy": "__policy", "part": "__part"}).hint("merge")
    joined = near.join(ranges, F.col("policy").eqNullSafe(F.col("__policy")) & (F.col("part") == F.col("__part")))
    return joined.select("policy", "page", both.alias("before"))


def _in_page(last: int) -> object:
    return Window.partitionBy("policy", "page").orderBy("seq").rowsBetween(Window.unboundedPreceding, last)


def carried(lines: DataFrame, value: Column, name: str, own: bool = True) -> DataFrame:
    """Add the last value that is not null above each line, or (own) on it."""
    told = lines.withColumn("__v", value)
    ends = told.groupBy("policy", "page").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("seq"))).alias("v"))
    joined = told.join(earlier_pages(ends, "last").hint("merge"), ["policy", "page"])
    here = F.last("__v", ignorenulls=True).over(_in_page(0 if own else -1))
    return joined.withColumn(name, F.coalesce(here, F.col("before"))).drop("__v", "before")


def counted(lines: DataFrame, flag: Column, name: str) -> DataFrame:
    """Add the number of lines for which the flag holds, up to each line."""
    told = lines.withColumn("__v", F.when(flag, 1).otherwise(0))
    sums = told.groupBy("policy", "page").agg(F.sum("__v").alias("v"))
    joined = told.join(earlier_pages(sums, "sum").hint("merge"), ["policy", "page"])
    return joined.withColumn(name, F.sum("__v").over(_in_page(0)) + F.col("before")).drop("__v", "before")


def page_lines(pages: DataFrame) -> DataFrame:
    """(policy, page, pos, seq, line): one ordered stream of lines for each document. (policy, page) is unique; null pages come first, null policies are one."""
    lines = F.split("text", "\n", -1)
    sizes = pages.select("policy", "page", F.coalesce(F.greatest(F.size(lines), F.lit(0)), F.lit(0)).cast("bigint").alias("v"))
    before = earlier_pages(sizes, "sum").withColumnsRenamed({"policy": "__policy", "page": "__page"}).hint("merge")
    joined = pages.join(before, F.col("policy").eqNullSafe(F.col("__policy")) & F.col("page").eqNullSafe(F.col("__page")))
    each = joined.select("policy", "page", F.posexplode(lines).alias("pos", "line"), "before")
    return each.select("policy", "page", "pos", (F.col("before") + F.col("pos") + 1).cast("int").alias("seq"), "line")


def furniture(lines: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(policy, line): trimmed lines on max(2, floor(pages * threshold)) distinct pages or more: headers and footers."""
    pages = lines.groupBy("policy").agg(F.countDistinct("page").alias("pages"))
    seen = lines.select("policy", F.trim("line").alias("line"), "page").where("line <> ''").groupBy("policy", "line")
    counts = seen.agg(F.countDistinct("page").alias("n")).join(pages, "policy")
    return counts.where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * threshold))).select("policy", "line")


def drop_furniture(lines: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Lines without headers, footers and bare page numbers."""
    gone = furniture(lines, threshold).withColumnRenamed("line", "gone").hint("merge")
    on = (lines["policy"] == gone["policy"]) & (F.trim(lines["line"]) == gone["gone"])
    return lines.join(gone, on, "left_anti").where(~F.trim("line").rlike(r"^(?i:page )?[0-9]+$"))


def section_carry(lines: DataFrame, banner: str) -> DataFrame:
    """Add ``section``: the last banner line at or above each line."""
    return carried(lines, F.when(F.col("line").rlike(banner), F.trim("line")), "section")


def heading_candidates(lines: DataFrame) -> DataFrame:
    """Add (number, title): a number, dotted or not, and a title of up to 120 characters that starts with a capital, digit or
    quote and has three letters in a row; null on other lines."""
    title = F.regexp_extract("line", HEADING, 2)
    good = F.col("line").rlike(HEADING) & (F.length(title) <= 120) & title.rlike(r"""^[A-Z0-9"']""") & title.rlike("[A-Za-z]{3}")
    return lines.withColumn("number", F.when(good, F.regexp_extract("line", HEADING, 1))).withColumn("title", F.when(good, title))


def with_following(headings: DataFrame, lines: DataFrame, n: int = 3) -> DataFrame:
    """Headings with next1 to next ``n``: the lines after each, null beyond the last. Lines are numbered without gaps."""
    asked = headings.select("policy", F.col("seq").alias("head"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"))
    asked = asked.withColumn("seq", (F.col("head") + F.col("i")).cast("int"))
    near = asked.hint("merge").join(lines.select("policy", "seq", "line"), ["policy", "seq"])
    each = [F.max(F.when(F.col("i") == i, F.col("line"))).alias(f"next{i}") for i in range(1, n + 1)]
    found = near.groupBy("policy", F.col("head").alias("seq")).agg(*each)
    return headings.join(found.hint("merge"), ["policy", "seq"], "left")


def strip(column: Column) -> Column:
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def looks_like_title(title: Column) -> Column:
    """Opens with a capital, digit, quote or bracket, is no row of figures, and has three letters in a row."""
    return title.rlike("""^[A-Z0-9‘“"(]""") & ~title.rlike(r"^(?i)[0-9\s.,%/₹Rs()-]+$") & title.rlike("[A-Za-z]{3}")


def is_table_debris(title: Column) -> Column:
    """A table marker, no words, more than a fifth figures, or capitals only with a digit."""
    words = F.filter(F.split(title, r"\s+"), lambda w: w != "")
    figures = F.size(F.filter(words, lambda w: w.rlike(r"^[0-9,.]+%?/?-?$")))
    capitals = (F.upper(title) == title) & (F.lower(title) != title) & title.rlike("[0-9]")
    return F.contains(title, F.lit(TABLE)) | (F.size(words) == 0) | (figures * 5 > F.size(words)) | capitals


def fix_letter_spacing(column: Column) -> Column:
    """Join a detached first capital with its word, at the start of the text only; never A or I before lower case.

    A word of capitals ends where no letter, digit or underscore of any script follows ("E INÖ" stays).
    """
    once = F.regexp_replace(column, r"^([B-HJ-Z])\s+([a-z]{2,})", "$1$2")
    return F.regexp_replace(once, r"^([A-Z])\s+([A-Z]{2,})(?![\p{L}\p{Nd}_])", "$1$2")


_ENDS = r"[ ,;:]+$"


def _before_colon(title: Column) -> Column:
    """The part before ': ' if it has 4 to 80 characters and three letters in a row; null otherwise."""
    head = F.substring_index(title, ": ", 1)
    return F.when(F.contains(title, F.lit(": ")) & F.length(head).between(4, 80) & head.rlike("[A-Za-z]{3}"), strip(F.regexp_replace(head, _ENDS, "")))


def complete_title(headings: DataFrame) -> DataFrame:
    """Add ``title``, from (raw, following): up to its colon; while it ends on a function word it goes on over the following lines, three at most.

    Step by step in columns, so that no step is planned more often than it is used.
    """
    told = headings.withColumn("__more", F.filter(F.transform("following", strip), lambda x: ~x.startswith(TABLE)))
    told = told.withColumn("title", fix_letter_spacing(strip(F.regexp_replace("raw", ":+$", "")))).withColumn("__head", _before_colon(F.col("title")))
    dangling = F.col("title").rlike(FUNCTION_WORDS.removesuffix("$") + r"\s*$")
    for i in range(3):
        told = told.withColumn("__on", F.col("__head").isNull() & (F.size("__more") > i) & dangling & (F.length("title") < 90))
        told = told.withColumn("title", F.when(F.col("__on"), F.concat("title", F.lit(" "), F.get("__more", F.lit(i)))).otherwise(F.col("title")))
        told = told.withColumn("__head", F.coalesce("__head", _before_colon(F.col("title"))))
    told = told.withColumn("__cut", F.substring("title", 1, 90))
    whole = F.when(F.contains("__cut", F.lit(" ")), F.regexp_extract("__cut", r"(?s)^(.*) [^ ]*$", 1)).otherwise(F.col("__cut"))
    short = F.when(F.length("title") > 90, whole).otherwise(F.col("title"))
    told = told.withColumn("title", F.coalesce("__head", strip(F.regexp_replace(short, _ENDS, ""))))
    return told.drop("__more", "__head", "__on", "__cut")


def islands(lines: DataFrame) -> DataFrame:
    """(policy, clause_id, title, n_lines, text, pos): the stream cut at headings; lines above the first are left out."""
    numbered = counted(lines, F.col("number").isNotNull(), "island").where("island > 0")
    body = F.array_sort(F.collect_list(F.when(F.col("number").isNull(), F.struct("seq", "line"))))
    return numbered.groupBy("policy", "island").agg(
        F.max("number").alias("clause_id"), F.max("title").alias("title"), F.min("seq").alias("pos"),
        F.count_if(F.col("number").isNull()).alias("n_lines"),
        F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("text"),
    )


def join_wrapped_lines(lines: DataFrame) -> DataFrame:
    """(policy, block, text): wrapped lines glued together.

    A line starts a block unless the one before it (blank lines left out) is plain text
    that ends no sentence; a heading or table row always starts one, and ends at itself.
    A trailing hyphen is stitched. Each decision reads the line before only, so looking
    back once and a running sum do what a fold would.
    """
    some = lines.where("trim(line) <> ''").withColumn("line", F.trim("line"))
    fixed = F.col("line").rlike(HEADING) | F.startswith(F.col("line"), F.lit(TABLE))
    told = carried(some.withColumn("fixed", fixed), F.struct("line", "fixed"), "last", own=False)
    starts = F.col("last").isNull() | F.col("fixed") | F.col("last.fixed") | F.col("last.line").rlike(r"[.!?:;]$")
    told = counted(told, starts, "block")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"])
    glued = F.regexp_replace(F.array_join(parts, "\n"), "-\n", "")
    return told.groupBy("policy", "block").agg(F.regexp_replace(glued, "\n", " ").alias("text"))


def drop_short(clauses: DataFrame, least: int = 60) -> DataFrame:
    return clauses.where(F.length("text") >= least)


def keep_fullest(clauses: DataFrame) -> DataFrame:
    """The longest text of each (policy, clause_id), the first of equally long ones."""
    order = Window.partitionBy("policy", "clause_id").orderBy(F.length("text").desc(), "pos")
    return clauses.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def split_definitions(clauses: DataFrame, mark: str = r"Def\. [0-9]+", least: int = 5, short: int = 40) -> DataFrame:
    """Clauses with ``least`` marks or more become one clause for each mark, ``parent.Def n``; bodies under ``short``
    characters go, and a clause of which nothing is left stays whole."""
    parts = F.slice(F.split("text", mark, -1), 2, 1_000_000)
    numbered = F.transform(parts, lambda p, i: F.struct((i + 1).alias("n"), F.trim(p).alias("t")))
    kept = F.filter(numbered, lambda p: F.length(p["t"]) >= short)
    split = clauses.withColumn("__d", F.when(F.regexp_count("text", F.lit(mark)) >= least, kept).otherwise(F.array().cast("array<struct<n:int,t:string>>")))
    whole = split.where(F.size("__d") == 0).drop("__d")
    each = split.where(F.size("__d") > 0).withColumn("__e", F.explode("__d"))
    each = each.withColumn("clause_id", F.concat(F.col("clause_id").cast("string"), F.lit(".Def "), F.col("__e.n")))
    title = F.trim(F.regexp_extract("__e.t", r"^(.*?)(?: means| refers to| is |$)", 1))
    each = each.withColumn("title", title).withColumn("text", F.col("__e.t")).drop("__d", "__e")
    return whole.withColumn("clause_id", F.col("clause_id").cast("string")).unionByName(each)


def trim_address_blocks(clauses: DataFrame, marker: str, least: int = 4, short: int = 60) -> DataFrame:
    """Clauses with ``least`` markers or more keep what follows the last line with one; under ``short`` characters they go."""
    lines = F.split("text", "\n", -1)
    last = F.array_max(F.transform(lines, lambda x, i: F.when(x.rlike(marker), i + 1)))
    rest = F.array_join(F.slice(lines, last + 1, F.greatest(F.size(lines) - last, F.lit(0))), "\n")
    block = F.regexp_count("text", F.lit(marker)) >= least
    out = clauses.withColumn("__b", block).withColumn("text", F.when(F.col("__b"), rest).otherwise(F.col("text")))
    return out.where(~F.col("__b") | (F.length("text") >= short)).drop("__b")


def extract_refs(clauses: DataFrame, shapes: tuple = REF_SHAPES, most: int = 12) -> DataFrame:
    """(policy, clause_id, refs): ids that a text names and the policy has, shape by shape in order of their first place, without itself.

    A shape is (what a mention looks like, what one id in it looks like): lists expand.
    """

    def ids(span: str, one: str) -> Column:
        return F.flatten(F.transform(F.regexp_extract_all("text", F.lit(span), F.lit(1)), lambda m: F.regexp_extract_all(m, F.lit(one), F.lit(0))))

    found = F.transform(F.flatten(F.array(*[ids(*s) for s in shapes])), lambda r: F.regexp_replace(r, SECTION_GAP, "$1."))
    named = clauses.select("policy", F.col("clause_id").cast("string").alias("clause_id"), F.posexplode(found).alias("at", "ref"))
    named = named.groupBy("policy", "clause_id", "ref").agg(F.min("at").alias("at"))
    known = clauses.select("policy", F.col("clause_id").cast("string").alias("ref")).distinct()
    named = named.join(known.hint("merge"), ["policy", "ref"], "left_semi")
    # A text names at most as many ids as its policy has; the list is cut right after it was sorted.
    refs = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "ref"))), lambda x: x["ref"]), 1, most)
    listed = named.groupBy("policy", "clause_id").agg(refs.alias("refs"))
    return listed.withColumn("refs", F.array_remove("refs", F.col("clause_id"))).where(F.size("refs") > 0)


def _bare(code: Column) -> Column:
    return F.regexp_replace(code, "^0+(?=.)", "")


def resolve_codes(clauses: DataFrame, code: str, head: int = 160, order: str = "clause_id") -> DataFrame:
    """(policy, code, clause_id): the first clause, by the column ``order``, that carries an exclusion code within its first ``head`` characters."""
    codes = F.array_distinct(F.regexp_extract_all(F.substring("text", 1, head), F.lit(code), F.lit(1)))
    each = clauses.select("policy", "clause_id", F.col(order).alias("__at"), F.explode(codes).alias("code"))
    each = each.withColumn("code", _bare(F.col("code")))
    return each.groupBy("policy", "code").agg(F.min_by("clause_id", F.struct("__at", "clause_id")).alias("clause_id"))


def append_code_refs(clauses: DataFrame, codes: DataFrame, mention: str = CODE_MENTION, most: int = 12) -> DataFrame:
    """Clauses (policy, clause_id, text, refs) whose refs also hold the clauses of the codes that they mention (``resolve_codes``).

    Targets come after the refs in order of their first mention, without repeats and
    without the clause itself; ``most`` in all.
    """
    mentions = F.regexp_extract_all("text", F.lit(mention), F.lit(1))
    each = clauses.select("policy", "clause_id", F.posexplode(mentions).alias("at", "code")).withColumn("code", _bare(F.col("code")))
    each = each.groupBy("policy", "clause_id", "code").agg(F.min("at").alias("at"))
    told = each.join(codes.select("policy", "code", F.col("clause_id").cast("string").alias("target")).hint("merge"), ["policy", "code"])
    # Codes have two digits at most, so a list has a hundred entries at most.
    lists = told.groupBy("policy", "clause_id").agg(F.array_sort(F.collect_list(F.struct("at", "target"))).alias("targets"))
    joined = clauses.join(lists.hint("merge"), ["policy", "clause_id"], "left")
    none = F.array().cast("array<string>")
    every = F.concat(F.coalesce("refs", none), F.coalesce(F.transform("targets", lambda t: t["target"]), none))
    return joined.withColumn("refs", F.slice(F.array_remove(F.array_distinct(every), F.col("clause_id").cast("string")), 1, most)).drop("targets")


def label_rule_type(clauses: DataFrame, rules: tuple, labels: DataFrame | None = None) -> DataFrame:
    """Add ``rule_type``: that of a table of labels (policy, clause_id, rule_type), else the first (pattern, type) that matches, else 'other'.

    Labels name a clause once and are not null; labels of clauses that are not there are left out.
    """
    case = F.lit("other")
    for pattern, kind in reversed(rules):
        case = F.when(F.col("text").rlike(pattern), kind).otherwise(case)
    if labels is not None:
        given = labels.select("policy", "clause_id", F.col("rule_type").alias("__given")).hint("merge")
        return clauses.join(given, ["policy", "clause_id"], "left").withColumn("rule_type", F.coalesce("__given", case)).drop("__given")
    return clauses.withColumn("rule_type", case)


def clause_documents(clauses: DataFrame) -> DataFrame:
    """(id, text, policy, title, page, rule_type): clauses as documents to index."""
    return clauses.select(F.concat_ws(":", "policy", "clause_id").alias("id"), "text", "policy", "title", "page", "rule_type")


def corpus_counts(clauses: DataFrame, entries: DataFrame | None = None, options: DataFrame | None = None) -> DataFrame:
    """(policy, rule_type, n): clauses by both, by either and over all, in one pass; null stands for 'all'.

    With ``entries`` also the size of the non-payable list (policy null), with
    ``options`` (policy, options) also how many sums insured each policy names.
    """
    out = clauses.cube("policy", "rule_type").agg(F.count(F.lit(1)).alias("n"))
    if entries is not None:
        out = out.unionByName(entries.agg(F.lit(None).cast("string").alias("policy"), F.lit("non-payable list").alias("rule_type"), F.count(F.lit(1)).alias("n")))
    if options is not None:
        out = out.unionByName(options.select("policy", F.lit("sums insured").alias("rule_type"), F.size("options").cast("bigint").alias("n")))
    return out


def table_rows(clauses: DataFrame, reads: str = ROOM_LIMIT) -> DataFrame:
    """(policy, clause_id, sum_insured, limit_text): table lines whose first column is the sum insured and whose limit
    reads as an entitlement to a room; the first row of each key."""
    row = r"^\[table\] Sum Insured ([0-9,]+)/- - Limit (.+)$"
    each = clauses.select("policy", "clause_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.col("line").rlike(row))
    each = each.where(F.regexp_extract("line", row, 2).rlike(reads))
    told = each.select(
        "policy", "clause_id", "pos", F.regexp_replace(F.regexp_extract("line", row, 1), ",", "").cast("bigint").alias("sum_insured"),
        F.regexp_extract("line", row, 2).alias("limit_text"),
    )
    return told.groupBy("policy", "clause_id", "sum_insured").agg(F.min_by("limit_text", "pos").alias("limit_text"))


def corruption_signals(clauses: DataFrame) -> DataFrame:
    """(policy, clause_id, signal): signs of a table that was flattened into text."""
    t = F.col("text")
    lines = F.split(t, "\n", -1)

    def soup(line: Column) -> Column:
        words = F.filter(F.split(line, " "), lambda w: w != "")
        numbers = F.size(F.filter(words, lambda w: w.rlike(r"^[0-9][0-9.,/-]*$")))
        return (F.size(words) >= 4) & (numbers * 5 >= F.size(words) * 2)

    signals = F.array_compact(
        F.array(
            F.when(F.regexp_count(t, F.lit(r"\b(?:days|months|per day)\b")) > 2, "units"),
            F.when(F.regexp_count(t, F.lit(r"(?i)\bup ?to\b")) > 2, "upto"),
            F.when(t.rlike(r"(?i)not covered[^\n]*[0-9]{3}"), "not covered"),
            F.when(F.exists(lines, soup), "numbers"),
            F.when(F.exists(lines, lambda x: F.regexp_count(x, F.lit(r"\b[0-9]{1,2}\. ")) >= 3), "lists"),
        )
    )
    return clauses.select("policy", "clause_id", F.explode(signals).alias("signal"))


def text_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(policy, clause_id, pos, expected, actual): lines that differ between two versions of the clauses' texts."""
    side = lambda df, name: df.select("policy", "clause_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", name))
    both = side(expected, "expected").join(side(actual, "actual"), ["policy", "clause_id", "pos"], "full_outer")
    return both.where("NOT (expected <=> actual)")


def index_coverage(clauses: DataFrame, floors: DataFrame) -> DataFrame:
    """(policy, characters, n, ok): characters and clauses of each policy against (policy, floor, pinned)."""
    sums = clauses.groupBy("policy").agg(F.sum(F.length("text")).alias("characters"), F.count(F.lit(1)).alias("n"))
    joined = sums.join(F.broadcast(floors), "policy")
    return joined.select("policy", "characters", "n", ((F.col("characters") >= F.col("floor")) & (F.col("n") * 100 >= F.col("pinned") * 95)).alias("ok"))


def squash(text: Column) -> Column:
    """Letters a to z and digits alone, so that joined lines and spaces break no match."""
    return F.regexp_replace(F.lower(text), "[^0-9a-z]", "")


def lost_pages(clauses: DataFrame, probes: DataFrame, size: int = 30, few: int = 1_000_000) -> DataFrame:
    """(policy, page): pages whose probe, ``size`` squashed characters, stands in no clause of the policy any more.

    A probe has to lie within one clause. Every run of ``size`` characters of every text
    meets the probes where the text lies, if they are few, else by a shuffle of hashes.
    """
    asked = probes.select("policy", "page", "probe").distinct()
    keys = asked.select("policy", F.xxhash64("probe").alias("__h")).distinct()
    keys = F.broadcast(keys) if keys.count() <= few else keys.hint("merge")
    grams = F.array_distinct(F.regexp_extract_all(squash(F.col("text")), F.lit("(?=(.{%d}))" % size), F.lit(1)))
    each = clauses.select("policy", F.explode(grams).alias("probe")).withColumn("__h", F.xxhash64("probe"))
    found = each.join(keys, ["policy", "__h"], "left_semi").select("policy", "probe").distinct()
    return asked.join(found.hint("merge"), ["policy", "probe"], "left_anti").select("policy", "page")


def fill_down(cells: DataFrame) -> DataFrame:
    """Add ``filled``: a blank data cell takes the value above it in its column; caption rows pass nothing on."""
    above = Window.partitionBy("table_id", "col", "is_data").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.trim("cell") != "", F.col("cell"))
    return cells.withColumn("filled", F.when(F.col("is_data"), F.last(value, ignorenulls=True).over(above)).otherwise(value))


def render_rows(filled: DataFrame, headers: DataFrame) -> DataFrame:
    """(table_id, row, line): data rows as ``header value - header value``."""
    joined = filled.where("is_data AND filled IS NOT NULL").join(headers, ["table_id", "col"])
    part = F.struct("col", F.concat_ws(" ", "header", "filled").alias("text"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), " - ")
    return joined.groupBy("table_id", "row").agg(F.concat(F.lit("[table] "), line).alias("line"))


def drop_phantom_spaces(glyphs: DataFrame) -> DataFrame:
    """Glyphs without spaces that lie in the box of the one before (within 0.5) on one line (under 1.0), between two letters."""
    order = Window.partitionBy("doc", "page").orderBy(F.round("top", 1), "x0", "n")
    told = glyphs.withColumns({"p": F.lag("char").over(order), "p_x1": F.lag("x1").over(order), "p_top": F.lag("top").over(order), "f": F.lead("char").over(order)})
    phantom = (
        (F.col("char") == " ") & (F.col("p") != " ") & (F.col("f") != " ") & (F.col("x1") <= F.col("p_x1") + 0.5) & (F.abs(F.col("top") - F.col("p_top")) < 1.0)
    )
    return told.where(~F.coalesce(phantom, F.lit(False))).drop("p", "p_x1", "p_top", "f")


def layout_vote(words: DataFrame, width: float) -> DataFrame:
    """(doc, share, two_columns): the upper median over pages of the share of lines that start right of the centre."""
    lines = words.groupBy("doc", "page", F.floor(F.col("top") / 3).alias("y")).agg(F.min("x0").alias("x0"))
    shares = lines.groupBy("doc", "page").agg(F.expr("CAST(count_if(x0 > %s) * 1000000 DIV count(1) AS BIGINT)" % (width / 2)).alias("share"))
    ranked = F.array_sort(F.collect_list("share"))
    voted = shares.groupBy("doc").agg(ranked.alias("s"))
    return voted.select("doc", F.col("s")[F.expr("CAST(size(s) DIV 2 AS INT)")].alias("share")).withColumn("two_columns", F.col("share") > 150000)


def echo_lines(lines: DataFrame, rendered: DataFrame) -> DataFrame:
    """(policy, seq): lines of which 80 % of the words stand in the policy's rendered tables (policy, word)."""
    words = lines.select("policy", "seq", F.explode(F.filter(F.split(F.lower("line"), " "), lambda w: w != "")).alias("word"))
    known = rendered.select("policy", "word").distinct().withColumn("echo", F.lit(1))
    told = words.join(known.hint("merge"), ["policy", "word"], "left").groupBy("policy", "seq").agg(F.count(F.lit(1)).alias("n"), F.count("echo").alias("k"))
    return told.where("k * 5 >= n * 4").select("policy", "seq")
