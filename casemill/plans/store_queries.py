"""Stored tables and listings: an upsert run twice, an audit of files, and repeated runs of transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import build, repeats
from ..operators.stored import Stored
from ..sources import tables
from .bindings import CASES_SQL, TURNS_SQL, Tables
from .queries import _EXISTING, _GENERATED, _MERGED, INFER_SQL, _as_text, _existing_overrides, _inferred, query


@query(f"+ {INFER_SQL}, {_GENERATED}, {_EXISTING}, {_MERGED} SELECT * FROM merged", CASES_SQL)
def override_store(t: Tables) -> DataFrame:
    """Overrides entered by hand, then the generated ones, then those once more."""
    at, store = t.folder("overrides"), Stored(t.spark, t.folder("upsert"))
    generated = build.generated_overrides(_as_text(_inferred(t)))
    for rows in (_existing_overrides(t), generated, generated):
        rewritten = build.upsert_stored(rows, at, store, buckets=16)
    if rewritten:
        raise ValueError("the second run of the same rows must change nothing")
    return t.spark.read.schema("case_number STRING, case_name STRING, override_case_type STRING, override_reason STRING").parquet(at).drop("bucket")


_HELD = "NOT (term_year % 2 = 0 AND starts_with(court, 'NATION_1'))"


@query(
    f"SELECT DISTINCT 'term_year=' || term_year || '/court=' || court AS local_path FROM cases EXCEPT SELECT 'term_year=' || term_year || '/court=' || court FROM cases WHERE {_HELD}", CASES_SQL
)
def missing_case_files(t: Tables) -> DataFrame:
    """A tree of files by year and court, of which some were never written: the listing shows which."""
    at = t.folder("files")
    t.cases.where(_HELD.replace("starts_with", "startswith")).select("case_number", "term_year", "court").repartition("term_year", "court").write.partitionBy("term_year", "court").json(at)
    place = F.concat(F.lit("term_year="), F.col("term_year"), F.lit("/court="), F.col("court"))
    expected = t.cases.select(place.alias("local_path")).distinct()
    listed = tables.list_files(t.spark, at, "*.json").select(F.regexp_replace("local_path", "/[^/]*$", "").alias("local_path"))
    return build.missing_files(expected, listed)


@query(
    """+ split AS (SELECT case_number, turn, [w FOR w IN regexp_split_to_array(lower(coalesce(text, '')), '\\s+') IF w <> ''] AS w FROM turns),
    words AS (SELECT case_number, turn, unnest(w) AS word, unnest(range(len(w))) AS i FROM split),
    placed AS (SELECT *, row_number() OVER (PARTITION BY case_number ORDER BY turn, i) - 1 AS p FROM words),
    pairs AS (SELECT a.case_number, a.p AS a, b.p AS b, a.turn AS ta, b.turn AS tb FROM placed a JOIN placed b ON a.case_number = b.case_number AND a.word = b.word AND a.p < b.p),
    islands AS (SELECT *, a - row_number() OVER (PARTITION BY case_number, b - a, ta, tb ORDER BY a) AS g FROM pairs),
    runs AS (SELECT case_number, min(a) AS first, min(b) AS second, count(*) AS length FROM islands GROUP BY case_number, b - a, ta, tb, g),
    best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY case_number ORDER BY length DESC, first, second) = 1)
    SELECT case_number, CAST(n AS BIGINT) AS n_words, coalesce(length, 0) AS length, first, second FROM (SELECT case_number, sum(len(w)) AS n FROM split GROUP BY case_number) LEFT JOIN best USING (case_number)""",
    TURNS_SQL,
)
def repeated_runs(t: Tables) -> DataFrame:
    return repeats.repeated_runs(t.turns, segment="turn").select("case_number", "n_words", "length", "first", "second")
