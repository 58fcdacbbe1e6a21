"""Building the case tables: normalisation, overrides, review queue, unions and increments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import clean as N
from .stored import Stored

#: The case types that an override may set.
VALID_TYPES = ("criminal", "civil", "family/domestic")
OVERRIDE_COLUMNS = ("case_number", "case_name", "override_case_type", "override_reason")


def first_per_key(df: DataFrame, key: str, *order) -> DataFrame:
    """One row per key, the first in an order that must be total."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def normalize_cases(df: DataFrame) -> DataFrame:
    """Clean the text fields, derive the case type and, for orders, say how it was found."""
    df = df.withColumns({
        "case_name": N.repair_name(F.col("case_name")), "lower_court": N.normalize_court(F.col("lower_court")),
        "outcome": N.normalize_outcome(F.col("outcome")), "summary_paragraph": N.clean_summary(F.col("summary_paragraph")),
        "rsa_citations": N.clean_citations(F.col("rsa_citations")),
    })
    df = df.withColumns({
        "rsa_primary": N.primary_citation(F.col("rsa_citations"), F.col("rsa_primary")),
        "case_type": N.case_type_from_topics(F.col("topics"), F.col("case_type")),
    })
    order = F.coalesce(F.lower(N.strip(F.col("opinion_type"))), F.lit("")) == "case_order"
    missing, by_topic = N.blank(F.col("case_type")), F.coalesce(F.size("topics"), F.lit(0)) > 0
    guess = N.infer_case_type(F.col("case_name"), F.col("rsa_citations"))
    df = df.withColumns({"_missing": missing, "_topic": by_topic, "_guess": guess})
    pick = lambda topic, guessed, present: F.when(F.col("_topic"), topic).when(F.col("_missing"), guessed).otherwise(present)
    return df.withColumns({
        "case_type": F.when(order & F.col("_missing") & ~F.col("_topic"), F.col("_guess.case_type")).otherwise(F.col("case_type")),
        "case_type_was_null": F.when(order, F.col("_missing")),
        "inference_confidence": F.when(order, pick(F.lit("high"), F.col("_guess.confidence"), F.lit("high"))),
        "inference_reason": F.when(order, pick(F.lit("topic_based"), F.col("_guess.reason"), F.lit("existing_case_type"))),
    }).drop("_missing", "_topic", "_guess")


def without_placeholders(df: DataFrame, name: str = "case_name", number: str = "case_number") -> DataFrame:
    """Drop the two placeholder entries of published lists; null fields stay."""
    low = lambda c: F.lower(N.strip(F.coalesce(F.col(c), F.lit(""))))
    return df.where((low(name) != "request a transcript") & (low(number) != "transcript-instructions"))


def without_cases(df: DataFrame, numbers: list[str], key: str = "case_number") -> DataFrame:
    return df.where(~F.lower(N.strip(F.coalesce(F.col(key), F.lit("")))).isin(*[n.lower() for n in numbers])) if numbers else df


def normalize_panel_orders(df: DataFrame, state: str = "new hampshire") -> DataFrame:
    """Orders of a three-justice panel: type by caption, fixed outcome and vote."""
    criminal = F.lower(F.coalesce(F.col("case_name"), F.lit(""))).rlike(f"^state of {state} v\\.")
    return df.withColumns({
        "case_type": F.when(criminal, "criminal").otherwise("civil"), "outcome": F.lit("issued"), "vote_string": F.lit("3JX Panel"),
    })


def align_panel_orders(df: DataFrame) -> DataFrame:
    """The columns of the case table: year (unless there is a term year), source and date."""
    if "term_year" not in df.columns:
        df = df.withColumnRenamed("year", "term_year")
    kind = F.col("opinion_type") if "opinion_type" in df.columns else F.lit(None).cast("string")
    day = F.col("date_issued").cast("string")
    return df.withColumns({
        "order_source": F.coalesce(kind, F.lit("3jx_order")),
        "date_issued": F.coalesce(N.us_date(day), F.try_to_timestamp(day).cast("date")),
    })


def union_orders(orders: DataFrame, panel: DataFrame) -> DataFrame:
    """All orders by column name; a column that one side lacks is null there, and the source of case orders is named."""
    if "order_source" not in orders.columns:
        orders = orders.withColumn("order_source", F.lit("case_order"))
    return without_placeholders(orders.unionByName(panel, allowMissingColumns=True))


def override_upsert(existing: DataFrame, generated: DataFrame) -> DataFrame:
    """Full outer merge on the case number: a filled-in field wins over a generated one.
    One row per case, and merging the result again changes nothing."""
    pick = lambda c: F.coalesce(F.nullif(N.strip(F.col(f"e.{c}")), F.lit("")), F.nullif(N.strip(F.col(f"g.{c}")), F.lit("")), F.lit("")).alias(c)
    one = lambda df: first_per_key(df.where(~N.blank(F.col("case_number"))), "case_number", *OVERRIDE_COLUMNS[1:])
    merged = one(existing).alias("e").join(one(generated).alias("g"), F.col("e.case_number") == F.col("g.case_number"), "full")
    return merged.select(F.coalesce("e.case_number", "g.case_number").alias("case_number"), *map(pick, OVERRIDE_COLUMNS[1:]))


def upsert_stored(generated: DataFrame, path: str, store: Stored, buckets: int = 64, key: str = "case_number") -> list[int]:
    """``override_upsert`` into the table stored at ``path`` in folders by a hash of the number.

    Only folders with a generated number are read, and only those with a row that changes are written, by dynamic
    partition overwrite: Spark writes them aside and puts them in place when the job commits, so a job that fails leaves the
    table as it was.  Returns the folders rewritten; running it again rewrites none.
    """
    spark = generated.sparkSession
    bucket = F.pmod(F.xxhash64(N.strip(F.col(key).cast("string"))), F.lit(buckets)).cast("int")
    new = store.table(generated.where(~N.blank(F.col(key))).select(*OVERRIDE_COLUMNS), "generated")
    touched = [r[0] for r in new.select(bucket.alias("b")).distinct().collect()]  # at most one row a folder
    schema = ", ".join(f"{c} STRING" for c in OVERRIDE_COLUMNS) + ", bucket INT"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    existing = (spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)).where(F.col("bucket").isin(touched))
    merged = store.table(override_upsert(existing.drop("bucket"), new).withColumn("bucket", bucket), "merged")
    old = existing.select(*(F.col(c).alias(f"_{c}") for c in OVERRIDE_COLUMNS))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in OVERRIDE_COLUMNS[1:]]
    joined = merged.join(old, F.col(key) == F.col(f"_{key}"), "left")
    changed = joined.where(F.col(f"_{key}").isNull() | ~reduce(Column.__and__, same))
    dirty = sorted(r[0] for r in changed.select("bucket").distinct().collect())
    if dirty:
        rows = merged.where(F.col("bucket").isin(dirty)).repartition(len(dirty), "bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    store.drop(new, merged)
    return dirty


def generated_overrides(cases: DataFrame) -> DataFrame:
    """Defaults for the cases that no rule has classified."""
    rows = cases.where(N.blank(F.col("case_type"))).withColumn("_d", N.default_case_type(F.col("case_name")))
    return rows.select("case_number", "case_name", F.col("_d.case_type").alias("override_case_type"), F.col("_d.reason").alias("override_reason"))


def override_apply(cases: DataFrame, overrides: DataFrame) -> DataFrame:
    """Set valid overrides of case orders; what they change has manual confidence.

    Opinions keep their type.  Numbers and types are compared trimmed, types in lower case too;
    of several overrides of a case the first type in the alphabet counts.
    """
    kind = F.lower(N.strip(F.col("override_case_type")))
    valid = overrides.select(N.strip(F.col("case_number")).alias("_number"), kind.alias("_type")).where(F.col("_type").isin(*VALID_TYPES) & (F.col("_number") != ""))
    order = F.lower(N.strip(F.col("opinion_type"))) == "case_order"
    keyed = cases.withColumn("_key", F.when(order, N.strip(F.col("case_number").cast("string"))))
    out = keyed.join(valid.groupBy("_number").agg(F.min("_type").alias("_type")), F.col("_key") == F.col("_number"), "left")
    hit = F.col("_type").isNotNull()
    return out.withColumns({
        "case_type": F.coalesce("_type", "case_type"),
        "inference_confidence": F.when(hit, "manual").otherwise(F.col("inference_confidence")),
        "inference_reason": F.when(hit, "manual_override_table").otherwise(F.col("inference_reason")),
    }).drop("_key", "_number", "_type")


def review_queue(cases: DataFrame) -> DataFrame:
    """Cases whose type was missing and is still missing or not certain."""
    unsure = N.blank(F.col("case_type")) | F.col("inference_confidence").isin("low", "medium", "none")
    return cases.where(F.col("case_type_was_null") & unsure)


def missing_files(expected: DataFrame, present: DataFrame, path: str = "local_path") -> DataFrame:
    """Expected files that a listing does not have."""
    return expected.join(present.select(path).distinct(), path, "left_anti")


def new_records(incoming: DataFrame, known: DataFrame, key: str = "case_number") -> DataFrame:
    """Records whose key is not known yet, each key once."""
    rest = [c for c in incoming.columns if c != key]
    return first_per_key(incoming.join(known.select(key), key, "left_anti"), key, *rest)


def corrections(parsed: DataFrame, manual: DataFrame, *columns: str, key: str = "case_number") -> DataFrame:
    """Values entered by hand over parsed ones, field by field."""
    fixed = manual.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    out = parsed.join(fixed, key, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def last_per_key(df: DataFrame, key: str, order: Column) -> DataFrame:
    """Lookup table in which the last of repeated keys counts."""
    return first_per_key(df, key, order.desc())


def cross_reference(orders: DataFrame, opinions: DataFrame, key: str = "case_number") -> DataFrame:
    """Orders with a flag for those that have an opinion in the same docket."""
    found = opinions.select(key).distinct().withColumn("_o", F.lit(True))
    return orders.join(found, key, "left").withColumn("has_opinion", F.coalesce("_o", F.lit(False))).drop("_o")
