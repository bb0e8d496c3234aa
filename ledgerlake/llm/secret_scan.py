"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by pattern in every whole text. Each candidate's value is
hashed, and over the whole corpus the distinct repositories and owners of each
hash are counted. A value that many owners hold has been copied from documentation
or an example; one that a single owner holds looks like a live credential. The
base kinds are reported as they are found; long mixed tokens (kind ``token``) have
no telling prefix, so they become spans only where the corpus shows a single owner.

Positions come from built-in functions: splitting a text at a pattern gives the
stretches between its matches, and the lengths of stretches and matches add up to
each match's start, in code points.

Counts are made in two steps that are both summed up before each shuffle (distinct
hash, owner and repository; then sums by hash), and the join back sets hashes apart
that hold a large share of all candidates. Texts are read once and never shuffled;
values are not kept beyond their hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import Scratch, join_by_key

# The patterns of the base kinds, in their order, and of the further candidates.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"
TOKEN = "[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "token")

#: From so many distinct owners on, a value counts as a widely copied example.
EXAMPLE_OWNERS = 3

_SPAN = "array<struct<start:int,kind:int,end:int,digest:string>>"


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost matches that do not overlap."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("before"), hits.alias("hit"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["before"])
        end = start + F.length(pair["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    # The last stretch has no match after it; zipping fills in a null there.
    whole = F.filter(pairs, lambda p: p["hit"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(whole, start, add, lambda s: s["out"])).otherwise(none)


def _spans(matches: Column, kind: int, keep, value) -> Column:
    kept = F.filter(matches, keep)
    return F.transform(
        kept,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), F.sha2(value(m), 256).alias("digest")
        ),
    )


def candidates(df: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column) -> DataFrame:
    """(id, text_hash, owner, repository, base, more): spans of each row, base kinds and further ones apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text).alias("text_hash"),
        owner.cast("string").alias("owner"),
        repository.cast("string").alias("repository"),
        _matches(text, ASSIGN).alias("assign"),
        _matches(text, ACCESS).alias("access"),
        _matches(text, HEX).alias("hex"),
        _matches(text, TOKEN).alias("token"),
    )
    second = lambda m: F.regexp_extract(m["value"], ASSIGN, 2)
    whole = lambda m: m["value"]
    base = F.concat(
        _spans(F.col("assign"), 0, lambda m: F.length(second(m)) >= 12, second),
        _spans(F.col("access"), 1, lambda m: F.length(m["value"]) >= 18, whole),
        _spans(F.col("hex"), 2, lambda m: F.length(m["value"]) >= 16, whole),
    )
    mixed = lambda m: m["value"].rlike("[0-9].*[0-9].*[0-9]") & m["value"].rlike("[A-Za-z]")
    found = rows.select(
        "id", "text_hash", "owner", "repository", F.array_sort(base).cast(_SPAN).alias("base"),
        _spans(F.col("token"), 3, mixed, whole).cast(_SPAN).alias("more"),
    )
    apart = lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    return found.withColumn("more", F.filter("more", apart))


def ownership(found: DataFrame) -> DataFrame:
    """(digest, n_owners, n_repositories, n_spans) of every candidate value in the corpus."""
    each = found.select("owner", "repository", F.explode(F.concat("base", "more")).alias("s"))
    each = each.groupBy(F.col("s.digest").alias("digest"), "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = each.groupBy("digest", "owner").agg(F.count("repository").alias("r"), F.sum("n").alias("n"))
    return by_owner.groupBy("digest").agg(
        F.count("owner").alias("n_owners"), F.sum("r").alias("n_repositories"), F.sum("n").alias("n_spans")
    )


def scan_secrets(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
    example_owners: int = EXAMPLE_OWNERS,
) -> DataFrame:
    """(id, base, spans): array<struct<start, kind, end, digest[, n_owners, n_repositories, live, example]>>.

    base: spans of the base kinds (assign, access, hex) in order of start, then
    kind. spans: these and the ``token`` spans whose value has a single owner, with
    the counts of each value; live: one owner at most; example: from
    ``example_owners`` on. Kinds are numbers into KINDS.

    A null text counts as empty and has no spans. A null owner or repository is
    not counted as one. Each input row gives one row, equal rows too; other columns
    are dropped. An empty table gives an empty result.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", owner, F.col("lang")) if repository is None else repository
    scratch = Scratch(df.sparkSession, "secrets")
    found = scratch.table(candidates(df, id_col, text_col, owner, repository), "found")
    with_spans = (F.size("base") + F.size("more")) > 0
    facts = scratch.table(ownership(found.where(with_spans)), "facts")
    total = facts.agg(F.coalesce(F.sum("n_spans"), F.lit(0))).first()[0]

    # Equal rows have equal spans: look values up once for them and repeat the row in the end.
    texts = found.where(with_spans).groupBy("id", "text_hash")
    texts = texts.agg(F.count(F.lit(1)).alias("times"), F.first("base").alias("base"), F.first("more").alias("more"))
    each = texts.select("id", "text_hash", "times", F.explode(F.concat("base", "more")).alias("s"))
    known = join_by_key(each.withColumn("digest", F.col("s.digest")), facts, "digest", "n_spans", total)
    told = F.struct(
        "s.start", "s.kind", "s.end", "s.digest", "n_owners", "n_repositories",
        (F.col("n_owners") <= 1).alias("live"), (F.col("n_owners") >= example_owners).alias("example"),
    )
    again = known.groupBy("id", "text_hash", "times").agg(F.array_sort(F.collect_list(told)).alias("all"))
    again = again.select(
        "id",
        F.filter("all", lambda s: s["kind"] < 3).alias("base"),
        F.filter("all", lambda s: (s["kind"] < 3) | s["live"]).alias("spans"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"),
    ).drop("copy")
    kind = again.schema["base"].dataType.simpleString()
    none = F.array().cast(kind)
    rest = found.where(~with_spans).select("id", none.alias("base"), none.alias("spans"))
    return rest.unionByName(again).withColumnRenamed("id", id_col)


def told(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document, with what the corpus says about their ownership."""
    scanned = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda column, keep: F.size(F.filter(column, keep)).cast("long")
    return scanned.select(
        "doc_id",
        count("base", lambda s: s["kind"] == 0).alias("n_assign"),
        count("base", lambda s: s["kind"] == 1).alias("n_access"),
        count("base", lambda s: s["kind"] == 2).alias("n_hex"),
        F.sha2(told("base"), 256).alias("base_sha256"),
        told("spans").alias("spans"),
        count("spans", lambda s: s["live"]).alias("n_live"),
        count("spans", lambda s: s["example"]).alias("n_example"),
    )


def _sql_matches(name: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  {name}_m AS (
    SELECT rid, u.i, u.hit, u.before FROM (
      SELECT rid, regexp_extract_all(t, '{quoted}') AS hits, regexp_split_to_array(t, '{quoted}') AS parts FROM d
    ), LATERAL (SELECT unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(parts[1:len(hits)]) AS before) u
  ), {name} AS (
    SELECT rid, hit, sum(length(before) + length(hit)) OVER (PARTITION BY rid ORDER BY i) - length(hit) AS s FROM {name}_m
  )"""


OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
{_sql_matches("assign", ASSIGN)}, {_sql_matches("access", ACCESS)}, {_sql_matches("hexa", HEX)}, {_sql_matches("tok", TOKEN)},
base AS (
  SELECT rid, s, 0 AS k, s + length(hit) AS e, regexp_extract(hit, '{ASSIGN.replace("'", "''")}', 2) AS v FROM assign
  WHERE length(regexp_extract(hit, '{ASSIGN.replace("'", "''")}', 2)) >= 12
  UNION ALL SELECT rid, s, 1, s + length(hit), hit FROM access WHERE length(hit) >= 18
  UNION ALL SELECT rid, s, 2, s + length(hit), hit FROM hexa WHERE length(hit) >= 16
), more AS (
  SELECT rid, s, 3 AS k, s + length(hit) AS e, hit AS v FROM tok
  WHERE regexp_matches(hit, '[0-9].*[0-9].*[0-9]') AND regexp_matches(hit, '[A-Za-z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = tok.rid AND b.s < tok.s + length(tok.hit) AND tok.s < b.e)
), every AS (SELECT * FROM base UNION ALL SELECT * FROM more),
owners AS (SELECT v, count(DISTINCT source) AS n FROM every JOIN d USING (rid) GROUP BY v),
named AS (
  SELECT rid, s, k, e, n, (['assign', 'access', 'hex', 'token'])[k + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS told
  FROM every JOIN owners USING (v)
), sums AS (
  SELECT rid, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
    coalesce(string_agg(told, ',' ORDER BY s, k, e) FILTER (k < 3), '') AS base_told,
    coalesce(string_agg(told, ',' ORDER BY s, k, e) FILTER (k < 3 OR n <= 1), '') AS all_told,
    count(*) FILTER (n <= 1) AS live, count(*) FILTER (n >= {EXAMPLE_OWNERS} AND k < 3) AS example
  FROM named GROUP BY rid
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base_told, '')) AS base_sha256, coalesce(all_told, '') AS spans,
  coalesce(live, 0) AS n_live, coalesce(example, 0) AS n_example
FROM d LEFT JOIN sums USING (rid)
"""
