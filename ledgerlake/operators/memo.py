"""Reuse of earlier results by the content that decided them."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlake.plans.scratch import folder, stored


def content_key(columns: list[str]) -> Column:
    """sha-256 of the columns as JSON, in alphabetical order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def fingerprint(config: dict) -> Column:
    """The identity of a run: a literal that every stored row carries."""
    return F.sha2(F.lit(json.dumps(config, sort_keys=True)), 256)


def identity(config: dict) -> str:
    """The same identity as text, to name a run's part of a store."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def read_store(spark: SparkSession, path: str, schema: str, run: str | None = None) -> DataFrame:
    """Rows of a store (``schema``, fingerprint, part), of one run where it is given: Spark reads that run's folders only.

    A store that does not exist yet is empty.
    """
    full = f"{schema}, fingerprint STRING, part STRING"
    try:
        rows = spark.read.schema(full).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], full)
    return rows if run is None else rows.where(F.col("fingerprint") == run)


def write_store(rows: DataFrame, path: str, run: str, part: str) -> None:
    """Put rows into a run's part. Only that part is replaced, when the job commits; other parts and runs stay.

    No rows replace nothing.
    """
    named = rows.withColumns({"fingerprint": F.lit(run), "part": F.lit(part)})
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fingerprint", "part").option("compression", "zstd").parquet(path)


def memoise_in(
    df: DataFrame, path: str, config: dict, columns: list[str], compute: Callable[[DataFrame], DataFrame], results: str, valid: Column, part: str | None = None,
) -> DataFrame:
    """df with the columns ``results`` (as in a schema) and ``replayed``, from the store at ``path`` or computed.

    ``config`` is all that can change a result beside the ``columns``: another one shares no
    rows. ``compute`` gets each unknown content once, as (key, ``columns``), and gives (key,
    ``results``); it runs once, its rows are written before anything reads them. Those that
    are not ``valid`` are returned but not kept, and contents it leaves out are absent from
    the result. A call that is repeated under the same ``part`` replays what that part holds
    and replaces it with the same rows and the new ones.

    Rows are shuffled once, without their key, which is made again where it is needed; rows of
    one content meet in one task. What is returned was written.
    """
    spark, run, part = df.sparkSession, identity(config), part or uuid.uuid4().hex
    schema = f"key STRING, {results}"
    types = spark.createDataFrame([], schema).schema.fields[1:]
    names = [t.name for t in types]
    result = F.struct(*[F.col(t.name).cast(t.dataType).alias(t.name) for t in types])
    known = read_store(spark, path, schema, run)
    own = known.where(F.col("part") == part).select("key", *names)
    own = None if own.isEmpty() else stored(own, folder(spark, "kept"))
    # Never null, said aloud: else Spark filters one branch below by it and shuffles the rows for each.
    own_key = F.coalesce(content_key(columns), F.lit(""))
    # One row of each content asks for it.
    place = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    looked = df.drop("key").repartition(own_key).withColumn("key", own_key).withColumn("__first", place == 1)
    if known.isEmpty():
        looked = looked.withColumn("__known", F.lit(None).cast(StructType(types)))
    else:
        # A key is twice as long in hex, so it is moved as bytes.
        text = F.lower(F.hex("bytes"))
        moved = known.select(F.unhex("key").alias("bytes"), *names).repartition(text).select(text.alias("key"), result.alias("__known"))
        looked = looked.join(moved.dropDuplicates(["key"]).hint("merge"), "key", "left")
    unknown = looked.where(F.col("__known").isNull() & F.col("__first")).select("key", *columns)
    done = compute(unknown).select("key", result.alias("__done")).dropDuplicates(["key"])
    told = looked.join(done.hint("merge"), "key", "left").withColumn("__result", F.coalesce("__known", "__done")).where("__result IS NOT NULL")
    others = [c for c in df.columns if c != "key"]
    told = stored(told.select(*others, "__result.*", F.col("__known").isNotNull().alias("replayed"), "__first"), folder(spark, "told"), "zstd")
    fresh = told.where(~F.col("replayed") & F.col("__first")).where(valid).select(content_key(columns).alias("key"), *names)
    write_store(fresh if own is None else fresh.unionByName(own), path, run, part)
    return told.drop("__first")


def memoise(df: DataFrame, store: DataFrame | None, columns: list[str], compute: Callable[[DataFrame], DataFrame], valid: Column) -> tuple[DataFrame, DataFrame]:
    """(results, fresh): stored rows for keys that are known, computed ones for the others.

    ``fresh`` are the computed rows that are valid, to be appended to the store.
    """
    keyed = df.withColumn("key", content_key(columns))
    if store is None:
        done = compute(keyed)
        return done, done.where(valid)
    known = store.dropDuplicates(["key"])
    hits = keyed.select("key").join(known, "key")
    done = compute(keyed.join(known.select("key"), "key", "left_anti"))
    return hits.select(*done.columns).unionByName(done), done.where(valid)


def resume_scored(bills: DataFrame, store: DataFrame, keys: tuple = ("bill_hash", "key_hash", "fingerprint", "version", "backend")) -> tuple[DataFrame, DataFrame]:
    """(finished, open): bills whose stored result matches on all keys, with it; and the others."""
    finished = store.join(bills.select("bill_id", *keys), ["bill_id", *keys], "left_semi")
    return finished, bills.join(store.select("bill_id", *keys), ["bill_id", *keys], "left_anti")
