"""Table schemas, readers and sinks.

Readers take explicit schemas, so nothing is inferred by a second pass.  Parquet is the primary
sink; CSV carries lists and maps as JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import clean as N
from ..functions import constants as K

#: The columns of each table.
VOTE = "display_name STRING, role STRING, vote STRING, note STRING"
CASES_DDL = (
    "case_number STRING, citation STRING, citation_year INT, citation_seq INT, case_name STRING, pdf_url STRING, date_argued DATE, "
    "date_issued DATE, days_to_decision INT, term_year INT, lower_court STRING, lower_court_type STRING, lower_court_judge STRING, "
    "case_type STRING, appeal_type STRING, outcome STRING, author STRING, author_display STRING, majority INT, dissent INT, "
    "concur_separate INT, not_participating INT, vote_string STRING, is_unanimous BOOLEAN, has_dissent BOOLEAN, "
    "has_separate_concurrence BOOLEAN, topics ARRAY<STRING>, rsa_citations ARRAY<STRING>, rsa_primary STRING, "
    "involves_statutory_interpretation BOOLEAN, standard_of_review ARRAY<STRING>, summary_paragraph STRING, word_count INT, "
    "opinion_type STRING, parse_version STRING, parse_timestamp TIMESTAMP, parse_confidence DOUBLE"
)
CASES = CASES_DDL
LIST_COLUMNS = ("topics", "rsa_citations", "standard_of_review")
CASES_NESTED = f"{CASES_DDL}, votes MAP<STRING, STRUCT<{VOTE}>>"
PANEL_ORDERS = (
    "year INT, pdf_url STRING, case_number STRING, case_name STRING, citation STRING, opinion_type STRING, date_issued STRING"
)
OVERRIDES = ("case_number STRING, case_name STRING, override_case_type STRING, override_reason STRING")
JUSTICES = (
    "key STRING, last_name STRING, first_name STRING, display_name STRING, role STRING, is_active BOOLEAN, appointed_by STRING, "
    "date_appointed DATE, date_retired DATE, political_affiliation STRING, wikipedia_url STRING"
)
STAGE = "STRUCT<status: STRING, completed_at: TIMESTAMP>"
TRANSCRIPT_STATUS = (", ".join(f"{s} {STAGE}" for s in ("discovery", "download", "transcription", "diarization", "public_render")))
TRANSCRIPT_STATS = (
    "case_path STRING, case_name STRING, docket_number STRING, argument_date DATE, model STRING, operational_quality_score INT, "
    "review_priority STRING, recommendation STRING, rerun_turbo_recommended BOOLEAN, warnings ARRAY<STRING>, metrics STRUCT<"
    "segment_count: INT, word_count: INT, character_count: INT, duration_seconds: DOUBLE, duration_minutes: DOUBLE, "
    "words_per_minute: DOUBLE, segments_per_minute: DOUBLE, questions_per_minute: DOUBLE, opening_counsel_index: INT, "
    "opening_counsel_start_seconds: DOUBLE, opening_counsel_start_minutes: DOUBLE, long_segment_count: INT, "
    "very_long_segment_count: INT, max_segment_words: INT, avg_words_per_segment: DOUBLE, median_words_per_segment: DOUBLE, "
    "p90_words_per_segment: INT, avg_chars_per_segment: DOUBLE, median_chars_per_segment: DOUBLE, long_segment_ratio: DOUBLE, "
    "duplicate_segment_instances: INT, repeated_segment_ratio: DOUBLE, repeated_window_count: INT, repeated_window_density: DOUBLE, "
    "question_segment_count: INT, question_mark_count: INT, exclamation_mark_count: INT, speaker_guess_counts: MAP<STRING, INT>, "
    "justice_guess_ratio: DOUBLE, counsel_guess_ratio: DOUBLE, language: STRING, language_probability: DOUBLE, beam_size: INT, compute_type: STRING>"
)
TRANSCRIPT_METADATA = (
    "argument_date DATE, docket_number STRING, case_name STRING, vimeo_url STRING, source_page_url STRING, source_label STRING, "
    "archive_root STRING, case_slug STRING, created_at TIMESTAMP, pipeline_status STRING, audio STRUCT<local_path: STRING, "
    "source_info_json: STRING, duration_seconds: DOUBLE, size_bytes: BIGINT, downloaded_at: TIMESTAMP, download_tool: STRING>, "
    "transcript STRUCT<raw_json_path: STRING, public_markdown_path: STRING, segment_count: INT, language: STRING, "
    "language_probability: DOUBLE, model: STRING, compute_type: STRING, beam_size: INT, initial_prompt: STRING, generated_at: TIMESTAMP>"
)


def _csv(spark: SparkSession, path: str, ddl: str, multi_line: bool) -> DataFrame:
    """The columns of ``ddl`` from a CSV with a header, by name in any order; absent ones are null, values that don't fit too.

    Quoted values may hold newlines, so a file is read by one task; if none does, ``multi_line=False`` lets large files be split."""
    raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    raw = raw.toDF(*(c.lstrip("\ufeff").strip() for c in raw.columns))

    def one(name: str, kind: str) -> Column:
        if name not in raw.columns:
            return F.lit(None).cast(kind).alias(name)
        c = F.col(f"`{name}`")
        if kind in ("int", "bigint"):  # nullable numbers are often written as 2020.0
            return F.coalesce(c.try_cast(kind), c.try_cast("double").try_cast(kind)).alias(name)
        return (F.try_to_timestamp(c).cast("date") if kind == "date" else c.try_cast(kind)).alias(name)

    return raw.select(*(one(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(ddl)))


def read_cases_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Flat case table from CSV; list columns are parsed, and empty where absent or malformed.
    A file is one task however large it is, unless ``multi_line`` is false (no value may hold a newline then)."""
    df = _csv(spark, path, CASES.replace("ARRAY<STRING>", "STRING"), multi_line)
    return df.withColumns({c: N.list_column(F.col(c)) for c in LIST_COLUMNS})


def _json(spark: SparkSession, paths: list[str], schema: str, multi_line: bool) -> DataFrame:
    """Records of JSON arrays; a whole file is one document unless ``multi_line`` is false: then each line is
    a record or an array of records, and large files are split."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(paths)


def read_case_json(spark: SparkSession, *paths: str, schema: str = CASES, multi_line: bool = True) -> DataFrame:
    """Case records from JSON array files; paths may be globs.  An empty array has no rows."""
    from ..operators.build import normalize_cases

    return normalize_cases(_json(spark, list(paths), schema, multi_line))


def read_cases_nested(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Case records with their votes."""
    return _json(spark, [path], CASES_NESTED, multi_line)


def read_justices(spark: SparkSession, path: str) -> DataFrame:
    """Justice dimension; of repeated keys the last in the file counts."""
    df = spark.read.schema(JUSTICES).option("multiLine", True).json(path).withColumn("_at", F.monotonically_increasing_id())
    return df.groupBy("key").agg(*(F.max_by(c, "_at").alias(c) for c in df.columns if c not in ("key", "_at")))


def read_taxonomy(spark: SparkSession, path: str, place: bool = False) -> DataFrame:
    """Topic dimension from an object of objects; with ``place``, each topic's number in the file, which orders tags."""
    whole = spark.read.text(path, wholetext=True)
    topics = F.from_json("value", "map<string, struct<label: string, description: string, keywords: array<string>>>")
    rows = whole.select(F.posexplode(topics).alias("place", "topic", "t")).select("place", "topic", "t.*")
    return rows if place else rows.drop("place")


def read_panel_orders(spark: SparkSession, *paths: str, multi_line: bool = True) -> DataFrame:
    return _json(spark, list(paths), PANEL_ORDERS, multi_line)


def read_overrides(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Overrides as strings: blanks and absent columns are empty, not null."""
    return _csv(spark, path, OVERRIDES, multi_line).na.fill("")


def read_case_text(spark: SparkSession, path: str, name: str = "([^/]+)\\.[^./]+$") -> DataFrame:
    """``case_number, text`` from one text file per case; ``name`` finds the number in the file's path."""
    found = F.regexp_extract(F.col("_metadata.file_path"), name, 1)
    return spark.read.text(path, wholetext=True).select(F.url_decode(F.replace(found, F.lit("+"), F.lit("%2B"))).alias("case_number"), F.col("value").alias("text"))


def list_files(spark: SparkSession, root: str, pattern: str = "*", base: str | None = None) -> DataFrame:
    """``local_path, modified, bytes`` of every file under ``root`` (any depth) whose name fits ``pattern``.

    Only the listing is read, not the files; ``local_path`` is what follows ``base`` (``root`` by default) in the path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    inside = F.substring_index(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), (base or root).rstrip("/") + "/", -1)
    return files.select(inside.alias("local_path"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def with_text(cases: DataFrame, texts: DataFrame, key: str = "case_number") -> DataFrame:
    """Cases with their text, empty where there is none."""
    return cases.join(texts, key, "left").withColumn("text", F.coalesce("text", F.lit("")))


def _tree(spark: SparkSession, root: str, name: str, schema: str, multi_line: bool) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", multi_line).option("recursiveFileLookup", True).option("pathGlobFilter", name)
    return reader.json(root).select("*", F.col("_metadata.file_path").alias("path"))


def read_transcript_stats(spark: SparkSession, root: str, name: str = "transcript_stats.json", multi_line: bool = True) -> DataFrame:
    return _tree(spark, root, name, TRANSCRIPT_STATS, multi_line)


def read_transcript_metadata(spark: SparkSession, root: str, name: str = "metadata.json", multi_line: bool = True) -> DataFrame:
    return _tree(spark, root, name, TRANSCRIPT_METADATA, multi_line)


def read_transcript_status(spark: SparkSession, root: str, name: str = "status.json", multi_line: bool = True) -> DataFrame:
    return _tree(spark, root, name, TRANSCRIPT_STATUS, multi_line)


def turns_of(markdown: DataFrame, key: str = "case_number", text: str = "text") -> DataFrame:
    """Turns from markdown: paragraphs ``**Speaker**: text``; other paragraphs are left out."""
    paragraphs = markdown.select(key, F.posexplode(F.split(text, "\\n\\s*\\n")).alias("turn", "_p"))
    pattern = "(?s)^\\s*\\*\\*(.+?)\\*\\*:\\s*(.*?)\\s*$"
    out = paragraphs.select(key, "turn", F.regexp_extract("_p", pattern, 1).alias("speaker"), F.regexp_extract("_p", pattern, 2).alias("text"))
    return out.where("speaker <> ''")


def read_transcript_turns(spark: SparkSession, path: str, **options) -> DataFrame:
    return turns_of(read_case_text(spark, path, **options))


def read_transcript_index(spark: SparkSession, path: str) -> DataFrame:
    """Index of transcripts from CSV, all columns as strings but the obvious numbers and dates."""
    df = spark.read.option("header", True).csv(path)
    return df.withColumns({
        "argument_date": F.to_date("argument_date"), "term_year": F.col("term_year").cast("int"),
        "duration_seconds": N.number(F.col("duration_seconds")), "segment_count": F.col("segment_count").cast("int"),
    })


def _flat(df: DataFrame, columns: tuple[str, ...] | None) -> DataFrame:
    types = dict(df.dtypes)
    names = [c for c in columns or df.columns]

    def one(c: str) -> Column:
        if c not in types:
            return F.lit(None).cast("string").alias(c)
        return F.to_json(c).alias(c) if types[c].startswith(("array", "map", "struct")) else F.col(c)

    return df.select(*map(one, names))


def write_flat_csv(df: DataFrame, path: str, columns: tuple[str, ...] | None = K.FLAT_COLUMNS) -> None:
    """CSV in fixed column order; lists and maps as JSON, absent columns empty."""
    _flat(df, columns).write.option("header", True).option("escape", '"').csv(path)


def write_cases_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_cases(df: DataFrame, path: str, year: str = "term_year") -> None:
    """Parquet by year, so that a filter on years reads only these."""
    df.write.partitionBy(year).parquet(path)


def export_csv(df: DataFrame, path: str, *columns: str) -> None:
    """A filtered result as CSV."""
    _flat(df, columns or None).write.option("header", True).option("escape", '"').csv(path)


def empty_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CASES)


def empty_orders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PANEL_ORDERS)
