"""Queries that write a given table in the form of a source, read it back and select, each with DuckDB SQL.

The files go to the shared folder that the session names.  Where a source has one small file for each
case, the file is written by Spark's partitioned writers and found by its folder's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import transcripts, votes
from ..sources import tables as S
from .bindings import CASES_SQL, TURNS_SQL, VOTES_SQL, Tables
from .queries import query


@query(
    """SELECT docket AS case_number, case_name, term_year, CASE WHEN case_number % 9 = 0 THEN NULL ELSE date_issued END AS date_issued, coalesce(array_to_string(topics, ';'), '') AS topics, 0 AS n_citations,
    CAST(NULL AS VARCHAR) AS outcome, is_unanimous FROM cases""",
    CASES_SQL,
)
def cases_csv(t: Tables) -> DataFrame:
    """A CSV of some of the columns in another order: lists as Python text, numbers as nullable ones are written."""
    at = t.folder("cases-csv")
    rows = t.cases.selectExpr(
        "is_unanimous", "concat('[''', array_join(topics, ''', '''), ''']') AS topics", "term_year || '.0' AS term_year", "CASE WHEN case_number % 9 = 0 THEN 'soon' ELSE CAST(date_issued AS STRING) END AS date_issued",
        "concat('two', chr(10), 'lines \"of\" text') AS note", "case_name", "docket AS case_number",
    )
    rows.write.option("header", True).option("escape", '"').csv(at)
    read = S.read_cases_csv(t.spark, at)
    return read.select("case_number", "case_name", "term_year", "date_issued", F.array_join("topics", ";").alias("topics"), F.size("rsa_citations").alias("n_citations"), "outcome", "is_unanimous")


@query(
    """SELECT docket AS case_number, case_name, term_year, array_to_string(rsa_citations, ';') AS rsa_citations, outcome, CAST(NULL AS VARCHAR) AS citation, CAST(word_count AS INT) AS word_count FROM cases""", CASES_SQL
)
def flat_csv(t: Tables) -> DataFrame:
    at = t.folder("flat-csv")
    S.write_flat_csv(t.cases.drop("case_number").withColumnRenamed("docket", "case_number"), at)
    read = S.read_cases_csv(t.spark, at)
    assert tuple(read.columns) == K.FLAT_COLUMNS
    # a null list is read as an empty one
    cites = F.when(F.size("rsa_citations") > 0, F.array_join("rsa_citations", ";"))
    return read.select("case_number", "case_name", "term_year", cites.alias("rsa_citations"), "outcome", "citation", "word_count")


@query("SELECT docket AS case_number, case_name, outcome, term_year FROM cases WHERE term_year BETWEEN 1996 AND 1998", CASES_SQL)
def yearly_json(t: Tables) -> DataFrame:
    """Files of record arrays in a folder for each year, of which some are read by a pattern and normalised."""
    at = t.folder("yearly-json")
    record = F.struct(F.col("docket").alias("case_number"), "case_name", F.upper("outcome").alias("outcome"), F.col("term_year"), "topics")
    arrays = t.cases.groupBy(F.col("term_year").alias("year"), F.floor(F.col("case_number") / 500)).agg(F.to_json(F.collect_list(record)).alias("value"))  # 500 at most
    arrays.select("year", "value").write.partitionBy("year").text(at)
    return S.read_case_json(t.spark, f"{at}/year=199[678]", multi_line=False).select("case_number", "case_name", "outcome", "term_year")


@query("SELECT CAST(case_number AS VARCHAR) AS case_number, justice_key, vote, justice_key || '!' AS display_name FROM votes", VOTES_SQL)
def nested_json(t: Tables) -> DataFrame:
    """Cases with their votes as a map, written and read as nested JSON."""
    at = t.folder("nested-json")
    vote = F.struct(F.concat("justice_key", F.lit("!")).alias("display_name"), F.lit("associate").alias("role"), F.col("vote").alias("vote"))
    nested = t.votes.groupBy(F.col("case_number").cast("string").alias("case_number")).agg(F.map_from_entries(F.collect_list(F.struct("justice_key", vote))).alias("votes"))  # a panel
    S.write_cases_json(nested, at)
    return votes.explode_votes(S.read_cases_nested(t.spark, at, multi_line=False)).select("case_number", "justice_key", "vote", "display_name")


@query("SELECT case_number, coalesce(max(vote) FILTER (WHERE justice_key = 'lynn'), 'not_participating') AS lynn FROM votes GROUP BY case_number", VOTES_SQL)
def vote_of_one(t: Tables) -> DataFrame:
    """A field of a map of structs, with a default."""
    maps = t.votes.groupBy("case_number").agg(F.map_from_entries(F.collect_list(F.struct("justice_key", F.struct("vote")))).alias("votes"))
    return maps.select("case_number", votes.vote_in("votes", "lynn").alias("lynn"))


@query(
    """SELECT 'r' || n_regionkey AS key, n_name AS last_name, CASE WHEN n_nationkey % 2 = 0 THEN make_date(1990, 1, 1) + CAST(n_nationkey AS INT) END AS date_appointed, CAST(NULL AS VARCHAR) AS role
    FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) = 1"""
)
def justices_json(t: Tables) -> DataFrame:
    """A dimension of 25 rows in one file, in which the last of repeated keys counts."""
    at = t.folder("justices-json")
    rows = t.raw("nation").selectExpr(
        "concat('r', n_regionkey) AS key", "n_name AS last_name", "CASE WHEN n_nationkey % 2 = 0 THEN date_add(DATE '1990-01-01', CAST(n_nationkey AS INT)) END AS date_appointed", "n_nationkey"
    )
    one = rows.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "key", "last_name", "date_appointed"))), lambda x: x.dropFields("n_nationkey"))).alias("value"))
    one.write.text(at)
    return S.read_justices(t.spark, at).select("key", "last_name", "date_appointed", "role")


@query("SELECT p_brand AS topic, 'Label of ' || p_brand AS label, array_to_string(list_sort(list(DISTINCT p_type)), ';') AS keywords FROM part GROUP BY p_brand")
def taxonomy_json(t: Tables) -> DataFrame:
    at = t.folder("taxonomy-json")
    topics = t.raw("part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_type")).alias("keywords"))
    entry = F.struct("p_brand", F.struct(F.concat(F.lit("Label of "), "p_brand").alias("label"), "keywords"))
    topics.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).write.text(at)  # 25 brands
    return S.read_taxonomy(t.spark, at).select("topic", "label", F.array_join("keywords", ";").alias("keywords"))


@query("SELECT docket AS case_number, case_name, term_year AS year, 'n/a' AS date_issued FROM cases WHERE status = 'O'", CASES_SQL)
def panel_json(t: Tables) -> DataFrame:
    """Arrays of panel orders beside a file that holds an empty array, put under the placeholder frame of orders."""
    at = t.folder("panel-json")
    record = F.struct(F.col("term_year").alias("year"), F.col("docket").alias("case_number"), "case_name", F.lit("n/a").alias("date_issued"))
    arrays = t.cases.where("status = 'O'").groupBy(F.floor(F.col("case_number") / 500)).agg(F.to_json(F.collect_list(record)).alias("value"))  # 500 at most
    arrays.select("value").write.text(f"{at}/full")
    t.spark.range(1).select(F.lit("[]").alias("value")).write.text(f"{at}/empty")
    read = S.read_panel_orders(t.spark, f"{at}/full", f"{at}/empty", multi_line=False)
    return S.empty_orders(t.spark).unionByName(read).select("case_number", "case_name", "year", "date_issued")


@query("SELECT docket AS case_number, count(*) AS n FROM cases GROUP BY docket", CASES_SQL)
def empty_frames(t: Tables) -> DataFrame:
    """The placeholder of an absent case table takes part in a union by name."""
    rows = t.cases.select(F.col("docket").alias("case_number"))
    return S.empty_cases(t.spark).unionByName(rows, allowMissingColumns=True).groupBy("case_number").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT docket AS case_number, '' AS case_name, CASE case_number % 3 WHEN 0 THEN '' WHEN 1 THEN 'civil' ELSE 'criminal' END AS override_case_type, CASE WHEN case_number % 2 = 0 THEN '' ELSE 'by hand, 01' END AS override_reason
    FROM cases WHERE status = 'P'""",
    CASES_SQL,
)
def overrides_csv(t: Tables) -> DataFrame:
    """Columns in another order, one of them absent; blanks stay blanks."""
    at = t.folder("overrides-csv")
    rows = t.cases.where("status = 'P'").selectExpr(
        "CASE WHEN case_number % 2 = 0 THEN NULL ELSE 'by hand, 01' END AS override_reason", "docket AS case_number", "CASE case_number % 3 WHEN 0 THEN '' WHEN 1 THEN 'civil' ELSE 'criminal' END AS override_case_type"
    )
    rows.write.option("header", True).csv(at)
    return S.read_overrides(t.spark, at)


@query("SELECT n_name AS case_number, n_regionkey, CASE WHEN n_regionkey = 2 THEN '' ELSE 'Text of ' || n_name || chr(10) || 'second line' || chr(10) END AS text FROM nation")
def case_texts(t: Tables) -> DataFrame:
    """One text file for each case, found by its path; a case without a file has an empty text."""
    at = t.folder("case-texts")
    cases = t.raw("nation").select(F.col("n_name").alias("case_number"), "n_regionkey")
    cases.where("n_regionkey <> 2").select("case_number", F.concat(F.lit("Text of "), "case_number", F.lit("\nsecond line")).alias("value")).write.partitionBy("case_number").text(at)
    return S.with_text(cases, S.read_case_text(t.spark, f"{at}/*/*", "case_number=([^/]+)/"))


_STAT = "count(*) AS segment_count, CAST(sum(length(text)) AS INT) AS character_count"


@query(f"SELECT CAST(case_number AS VARCHAR) AS docket_number, CAST(count(*) AS INT) AS segment_count, CAST(sum(length(text)) AS INT) AS character_count, 'none;' || case_number AS warnings FROM turns GROUP BY case_number", TURNS_SQL)
def stats_tree(t: Tables) -> DataFrame:
    """A tree of statistics files, read whatever their depth and flattened to one row per case."""
    at = t.folder("stats-tree")
    stats = t.turns.groupBy("case_number").agg(F.count(F.lit(1)).alias("segment_count"), F.sum(F.length("text")).alias("character_count"))
    nested = stats.select(
        F.col("case_number").cast("string").alias("docket_number"), F.array(F.lit("none"), F.col("case_number").cast("string")).alias("warnings"), F.struct("segment_count", "character_count").alias("metrics"),
        (F.col("case_number") % 3).alias("year"), (F.col("case_number") % 2).alias("day"),
    )
    nested.write.partitionBy("year", "day").json(at)
    flat = transcripts.stats_index(S.read_transcript_stats(t.spark, at, "*.json", multi_line=False))
    return flat.select("docket_number", "segment_count", "character_count", F.array_join("warnings", ";").alias("warnings"))


@query("SELECT CAST(conv_id AS VARCHAR) AS docket_number, CAST(max(turn) AS DOUBLE) AS seconds, CAST(count(*) AS INT) AS segments FROM conversations GROUP BY conv_id")
def metadata_tree(t: Tables) -> DataFrame:
    at = t.folder("metadata-tree")
    rows = t.raw("conversations").groupBy("conv_id").agg(F.max("turn").alias("m"), F.count(F.lit(1)).alias("n"))
    nested = rows.select(
        F.col("conv_id").cast("string").alias("docket_number"), F.struct(F.col("m").cast("double").alias("duration_seconds")).alias("audio"), F.struct(F.col("n").alias("segment_count")).alias("transcript"), (F.col("conv_id") % 4).alias("year")
    )
    nested.write.partitionBy("year").json(at)
    read = S.read_transcript_metadata(t.spark, at, "*.json", multi_line=False)
    return read.select("docket_number", F.col("audio.duration_seconds").alias("seconds"), F.col("transcript.segment_count").alias("segments"))


@query(
    """SELECT stage, status, count(*) AS n FROM (SELECT 'download' AS stage, CASE WHEN event_id % 3 = 0 THEN 'complete' ELSE 'pending' END AS status FROM events UNION ALL SELECT 'diarization', 'pending' FROM events
    UNION ALL SELECT 'discovery', 'complete' FROM events UNION ALL SELECT 'transcription', 'pending' FROM events UNION ALL SELECT 'public_render', 'pending' FROM events) GROUP BY ALL"""
)
def status_tree(t: Tables) -> DataFrame:
    at = t.folder("status-tree")
    rows = t.raw("events").selectExpr("named_struct('status', 'complete') AS discovery", "CASE WHEN event_id % 3 = 0 THEN named_struct('status', 'complete') END AS download", "event_id % 4 AS year")
    rows.write.partitionBy("year").json(at)
    return transcripts.stage_rollup(S.read_transcript_status(t.spark, at, "*.json", multi_line=False))


@query("SELECT case_number, CAST(row_number() OVER (PARTITION BY case_number ORDER BY turn) - 1 AS INT) AS turn, speaker, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM turns", TURNS_SQL)
def markdown_turns(t: Tables) -> DataFrame:
    """Turns as paragraphs of one markdown text for each case, and back."""
    plain = F.trim(F.regexp_replace("text", "\\s+", " "))
    paragraph = F.concat(F.lit("**"), "speaker", F.lit("**: "), plain)
    one = t.turns.groupBy("case_number").agg(F.sort_array(F.collect_list(F.struct("turn", paragraph.alias("p")))).alias("ps"))  # a conversation
    return S.turns_of(one.select("case_number", F.array_join(F.col("ps.p"), "\n\n").alias("text")))


@query("SELECT docket AS case_number, case_name, '[\"' || array_to_string(topics, '\",\"') || '\"]' AS topics FROM cases WHERE outcome = 'affirmed' AND topics IS NOT NULL", CASES_SQL)
def exported_csv(t: Tables) -> DataFrame:
    at = t.folder("export-csv")
    picked = t.cases.where("outcome = 'affirmed' AND topics IS NOT NULL").select(F.col("docket").alias("case_number"), "case_name", "topics", "term_year")
    S.export_csv(picked, at, "case_number", "case_name", "topics")
    return t.spark.read.option("header", True).option("escape", '"').csv(at)


@query("SELECT docket AS case_number, argument_date, term_year, duration_seconds, segment_count FROM (SELECT *, date_issued AS argument_date, CAST(case_number % 100 + 0.5 AS DOUBLE) AS duration_seconds, CAST(case_number % 7 AS INT) AS segment_count FROM cases)", CASES_SQL)
def transcript_index(t: Tables) -> DataFrame:
    """The flat index of transcripts, all of it quoted."""
    at = t.folder("transcript-index")
    rows = t.cases.selectExpr("docket AS case_number", "date_issued AS argument_date", "term_year", "case_number % 100 + 0.5 AS duration_seconds", "CAST(case_number % 7 AS INT) AS segment_count")
    rows.write.option("header", True).option("quoteAll", True).csv(at)
    return S.read_transcript_index(t.spark, at)
