"""Queries of single-field functions, filters and orders, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean as N
from ..operators import build, reports, text, votes
from ..streaming.incremental import streaming_counts
from .bindings import APPOINTED_SQL, CASES_SQL, ROSTER_SQL, VOTES_SQL, Tables
from .queries import INFER_SQL, query

BAD = "�"

# Cleaning -----------------------------------------------------------------------------------

_OUTCOME = "CASE case_number % 4 WHEN 0 THEN '  REMANED ' WHEN 1 THEN upper(outcome) || ' ' ELSE outcome END"


@query(f"SELECT case_number, CASE WHEN lower(trim(x)) = 'remaned' THEN 'remanded' ELSE lower(trim(x)) END AS outcome FROM (SELECT case_number, {_OUTCOME} AS x FROM cases)", CASES_SQL)
def normalize_outcomes(t: Tables) -> DataFrame:
    return t.cases.selectExpr("case_number", f"{_OUTCOME} AS x").select("case_number", N.normalize_outcome(F.col("x")).alias("outcome"))


_SUMMARY = f"CASE case_number % 3 WHEN 0 THEN ' [\"(' || case_name || '{BAD}.)]\" ' WHEN 1 THEN '“' || case_name || '” and ”more”' ELSE NULL END"
_JUNK = "[\\]\\[(){}\"''“”‘’`]+"


@query(
    f"SELECT case_number, trim(regexp_replace(regexp_replace(trim(replace(x, '{BAD}', '')), '^\\s*{_JUNK}\\s*', ''), '\\s*{_JUNK}\\s*$', '')) AS summary FROM (SELECT case_number, {_SUMMARY} AS x FROM cases)",
    CASES_SQL,
)
def clean_summaries(t: Tables) -> DataFrame:
    return t.cases.selectExpr("case_number", f"{_SUMMARY} AS x").select("case_number", N.clean_summary(F.col("x")).alias("summary"))


@query(
    f"SELECT case_number, regexp_replace(x, '(\\w){BAD}(\\w)', '\\1''\\2', 'g') AS case_name FROM (SELECT case_number, CASE WHEN case_number % 2 = 0 THEN replace(case_name, '#', '{BAD}') ELSE case_name || ' {BAD}' END AS x FROM cases)",
    CASES_SQL,
)
def repair_names(t: Tables) -> DataFrame:
    rows = t.cases.selectExpr("case_number", f"CASE WHEN case_number % 2 = 0 THEN replace(case_name, '#', '{BAD}') ELSE case_name || ' {BAD}' END AS x")
    return rows.select("case_number", N.repair_name(F.col("x")).alias("case_name"))


_BY_TOPIC = "CASE WHEN topics IS NULL THEN case_type WHEN list_has_any(topics, ['family_law', 'domestic_violence']) THEN 'family/domestic' WHEN list_contains(topics, 'criminal') THEN 'criminal' ELSE 'civil' END"


@query(f"SELECT case_number, {_BY_TOPIC} AS case_type FROM cases", CASES_SQL)
def types_from_topics(t: Tables) -> DataFrame:
    return t.cases.select("case_number", N.case_type_from_topics(F.col("topics"), F.col("case_type")).alias("case_type"))


@query(
    f"""+ {INFER_SQL}, typed AS (SELECT c.*, {_BY_TOPIC.replace("case_type", "c.case_type")} AS ty, i.case_type AS guess, i.confidence, i.reason FROM cases c JOIN inferred i ON i.case_number = c.case_number)
    SELECT case_number, CASE WHEN opinion_type = 'case_order' AND ty IS NULL THEN guess ELSE ty END AS case_type, CASE WHEN opinion_type = 'case_order' THEN ty IS NULL END AS case_type_was_null,
    CASE WHEN opinion_type = 'case_order' THEN CASE WHEN topics IS NULL AND ty IS NULL THEN confidence ELSE 'high' END END AS inference_confidence,
    CASE WHEN opinion_type = 'case_order' THEN CASE WHEN topics IS NOT NULL THEN 'topic_based' WHEN ty IS NULL THEN reason ELSE 'existing_case_type' END END AS inference_reason,
    CASE case_number % 8 WHEN 0 THEN 'RSA 458:7' WHEN 1 THEN 'RSA 631:2' WHEN 2 THEN 'RSA 318-B' WHEN 4 THEN 'RSA 91-A:5' WHEN 5 THEN 'RSA 541-A:31' ELSE 'before' END AS rsa_primary,
    CASE WHEN case_number % 5 = 0 THEN 'remanded' ELSE outcome END AS outcome FROM typed""",
    CASES_SQL,
)
def normalized_cases(t: Tables) -> DataFrame:
    rows = t.cases.withColumns({
        "summary_paragraph": F.lit(None).cast("string"), "rsa_primary": F.lit("before"), "outcome": F.expr("CASE WHEN case_number % 5 = 0 THEN ' Remaned' ELSE outcome END"),
    })
    return build.normalize_cases(rows).select("case_number", "case_type", "case_type_was_null", "inference_confidence", "inference_reason", "rsa_primary", "outcome")


_CITE = "CASE case_number % 3 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE '2020 N.H. ' || case_number END"
_NUMBER = "CASE WHEN case_number % 7 = 0 THEN NULL ELSE docket END"


@query(
    f"""SELECT case_number, coalesce(nullif(trim({_CITE}), ''), {_NUMBER}, 'unknown') AS citation, CASE WHEN length(case_name) > 20 THEN substr(case_name, 1, 20) || '...' ELSE case_name END AS preview,
    coalesce(strftime(CASE WHEN case_number % 6 = 0 THEN NULL ELSE date_issued END, '%b %d, %Y'), '—') AS issued, strftime(date_issued, '%m-%d') AS month_day,
    '?case=' || docket || '%2Fx%3A1' AS link, date_diff('day', date_issued - CAST(case_number % 50 AS INT), date_issued) AS days FROM cases""",
    CASES_SQL,
)
def case_display(t: Tables) -> DataFrame:
    rows = t.cases.selectExpr("*", f"{_CITE} AS cite", f"{_NUMBER} AS number", "CASE WHEN case_number % 6 = 0 THEN NULL ELSE date_issued END AS shown", "date_sub(date_issued, CAST(case_number % 50 AS INT)) AS argued")
    return rows.select(
        "case_number", N.display_citation(F.col("cite"), F.col("number")).alias("citation"), N.preview(F.col("case_name"), 20).alias("preview"), N.display_date(F.col("shown")).alias("issued"),
        N.month_day(F.col("date_issued")).alias("month_day"), N.case_link(F.concat("docket", F.lit("/x:1"))).alias("link"), N.days_to_decision(F.col("date_issued"), F.col("argued")).cast("long").alias("days"),
    )


@query('SELECT case_number AS "Case Number", term_year AS "Term Year", outcome AS "Outcome" FROM cases', CASES_SQL)
def titled_columns(t: Tables) -> DataFrame:
    return N.title_columns(t.cases.select("case_number", "term_year", "outcome"))


@query(
    """SELECT c_custkey AS id, coalesce(CAST(year(first_day) AS VARCHAR), '—') AS since
    FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_day FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey"""
)
def roster_years(t: Tables) -> DataFrame:
    """The year in which each customer first ordered, in the form of a roster."""
    first = t.raw("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_day"))
    rows = t.raw("customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select(F.col("c_custkey").alias("id"), N.roster_year(F.col("first_day").cast("date")).alias("since"))


_BODY = "'Intro of ' || case_name || chr(10) || chr(10) || chr(10) || chr(10) || 'more'"
_TEXT = f"""CASE case_number % 4 WHEN 0 THEN 'Header' || chr(10) || 'DONOVAN, J. ' || {_BODY} || chr(10) || 'Background' || chr(10) || 'rest' WHEN 1 THEN 'PER CURIAM. ' || {_BODY}
 WHEN 2 THEN {_BODY} || chr(10) || 'II. no heading' || chr(10) || 'I. Facts' || chr(10) || 'rest' ELSE NULL END"""
_SHORT = "'Intro of ' || case_name || chr(10) || chr(10) || 'more'"


@query(f"SELECT case_number, CASE case_number % 4 WHEN 2 THEN {_SHORT} || chr(10) || 'II. no heading' WHEN 3 THEN '' ELSE {_SHORT} END AS intro FROM cases", CASES_SQL)
def intro_excerpts(t: Tables) -> DataFrame:
    return t.cases.selectExpr("case_number", f"{_TEXT} AS x").select("case_number", N.intro_excerpt(F.col("x")).alias("intro"))


@query("SELECT case_number, regexp_replace(opinion, '(RSA\\s+[\\d\\-A-Z:]+)', '<mark>\\1</mark>', 'g') AS marked FROM cases", CASES_SQL)
def marked_citations(t: Tables) -> DataFrame:
    return t.cases.select("case_number", N.mark_citations(F.col("opinion")).alias("marked"))


_LISTED = "CASE case_number % 4 WHEN 0 THEN '[''RSA 1'', '''', ''' || docket || ''']' WHEN 1 THEN '[\"a, b\"]' WHEN 2 THEN '[broken' ELSE NULL END"


@query("SELECT case_number, CASE case_number % 4 WHEN 0 THEN 'RSA 1;' || docket WHEN 1 THEN 'a, b' ELSE '' END AS items, CASE case_number % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n FROM cases", CASES_SQL)
def list_columns(t: Tables) -> DataFrame:
    rows = t.cases.selectExpr("case_number", f"{_LISTED} AS x").withColumn("x", N.list_column(F.col("x")))
    return rows.select("case_number", F.array_join("x", ";").alias("items"), F.size("x").alias("n"))


@query(
    """SELECT case_number, CASE case_number % 5 WHEN 0 THEN 'Criminal | Evidence' WHEN 1 THEN 'Family Law' WHEN 2 THEN 'Evidence | Insurance | Contracts' WHEN 3 THEN '—' ELSE 'Criminal | Family Law' END AS topics FROM cases""",
    CASES_SQL,
)
def topic_display(t: Tables) -> DataFrame:
    return t.cases.select("case_number", N.topic_labels(F.col("topics")).alias("topics"))


# Filters ------------------------------------------------------------------------------------


@query("SELECT case_number FROM cases WHERE regexp_matches(lower(case_name), '^custody|v\\. cust.*[05]$')", CASES_SQL)
def name_search(t: Tables) -> DataFrame:
    return reports.matching(t.cases, "^custody|v\\. cust.*[05]$", ["case_name"], regex=True).select("case_number")


@query("SELECT case_number FROM cases WHERE regexp_matches(upper(array_to_string(rsa_citations, ' | ')), 'RSA (458|91-A):[57]')", CASES_SQL)
def statute_search(t: Tables) -> DataFrame:
    return reports.matching(t.cases, "RSA (458|91-A):[57]", ["rsa_citations"], regex=True).select("case_number")


_EXCLUDED = ["2000-0001", " 2000-0002", "2000-0007", "2001-0033"]


@query("SELECT case_number FROM cases WHERE case_number % 50 = 49 OR docket NOT IN ('2000-0001', '2000-0007', '2001-0033')", CASES_SQL)
def excluded_cases(t: Tables) -> DataFrame:
    rows = t.cases.selectExpr("case_number", "CASE WHEN case_number % 50 = 49 THEN NULL ELSE docket END AS docket")
    return build.without_cases(rows, [x for x in _EXCLUDED if x == x.strip()], "docket").select("case_number")


@query("SELECT case_number, case_name FROM cases WHERE docket = '2000-0007'", CASES_SQL)
def one_case(t: Tables) -> DataFrame:
    return reports.one_case(t.cases, "2000-0007", "docket").select("case_number", "case_name")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 3 = 1")
def active_justices(t: Tables) -> DataFrame:
    rows = t.raw("supplier").selectExpr("s_suppkey AS id", "CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS is_active")
    return votes.active_justices(rows).select("id")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 3 <> 1")
def retired_justices(t: Tables) -> DataFrame:
    rows = t.raw("supplier").selectExpr("s_suppkey AS id", "CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS is_active")
    return votes.active_justices(rows, False).select("id")


#: Cases whose term year is sometimes missing, and then their citation year.
_YEARS = {"term_year": "CASE WHEN case_number % 19 = 0 THEN 0 WHEN case_number % 29 = 0 THEN NULL ELSE term_year END", "citation_year": "CASE WHEN case_number % 3 = 0 THEN NULL ELSE CAST(1990 + case_number % 12 AS INT) END"}
_YEARS_SQL = f"""dated AS (SELECT case_number, author, CASE WHEN case_number % 31 = 0 THEN NULL ELSE date_issued END AS date_issued, {', '.join(f'{e} AS {c}' for c, e in _YEARS.items())} FROM cases),
years AS (SELECT *, coalesce(nullif(term_year, 0), nullif(citation_year, 0)) AS effective_year FROM dated)"""


def _dated(t: Tables) -> DataFrame:
    return t.cases.selectExpr("case_number", "author", "CASE WHEN case_number % 31 = 0 THEN NULL ELSE date_issued END AS date_issued", *(f"{e} AS {c}" for c, e in _YEARS.items()))


@query(f"+ {_YEARS_SQL} SELECT case_number, effective_year FROM years WHERE effective_year BETWEEN 1993 AND 1999", CASES_SQL)
def effective_years(t: Tables) -> DataFrame:
    return votes.with_year(_dated(t), 1993, 1999, citation="citation_year").select("case_number", "effective_year")


@query(
    f"""+ {_YEARS_SQL}, took AS (SELECT v.* FROM votes v JOIN years USING (case_number) WHERE effective_year BETWEEN 1993 AND 1999 AND vote NOT IN ('not_participating', 'recused', 'disqualified'))
    SELECT a.justice_key AS justice_1, b.justice_key AS justice_2, count(*) AS shared, count_if(a.vote = b.vote) AS agreed, round(count_if(a.vote = b.vote) / count(*), 4) AS agreement
    FROM took a JOIN took b ON a.case_number = b.case_number AND a.justice_key < b.justice_key GROUP BY ALL""",
    CASES_SQL, VOTES_SQL,
)
def agreement_in_years(t: Tables) -> DataFrame:
    return votes.agreement_pairs(votes.votes_in_years(t.votes, _dated(t), 1993, 1999, citation="citation_year"))


@query(
    f"""+ {_YEARS_SQL}, heard AS (SELECT v.justice_key, count_if(vote IN ('majority', 'dissent', 'concur_separate')) AS participated, count_if(vote = 'dissent') AS dissents FROM votes v JOIN years USING (case_number)
      JOIN appointed a ON a.justice_key = v.justice_key WHERE effective_year BETWEEN 1993 AND 1999 AND CASE WHEN date_appointed IS NULL THEN true WHEN date_issued IS NOT NULL THEN date_issued >= date_appointed ELSE effective_year >= year(date_appointed) END GROUP BY ALL),
    wrote AS (SELECT author AS justice_key, count(*) AS authored FROM years JOIN appointed ON author = justice_key WHERE nullif(term_year, 0) BETWEEN 1993 AND 1999 AND (date_appointed IS NULL OR date_issued >= date_appointed) GROUP BY author)
    SELECT r.justice_key, coalesce(participated, 0) AS participated, coalesce(dissents, 0) AS dissents, coalesce(authored, 0) AS authored FROM roster r LEFT JOIN heard h ON h.justice_key = r.justice_key LEFT JOIN wrote w ON w.justice_key = r.justice_key""",
    CASES_SQL, VOTES_SQL, ROSTER_SQL, APPOINTED_SQL,
)
def profile_in_years(t: Tables) -> DataFrame:
    out = votes.justice_profile(_dated(t), t.votes, t.appointed, 1993, 1999, citation="citation_year")
    return out.select("justice_key", "participated", "dissents", "authored")


# Order, lookups and sets ------------------------------------------------------------------------

_DAY = "CASE case_number % 5 WHEN 0 THEN month(date_issued) || '/' || day(date_issued) || '/' || year(date_issued) WHEN 1 THEN 'soon' WHEN 2 THEN NULL ELSE CAST(date_issued AS STRING) END"
_TERM = "CASE case_number % 3 WHEN 0 THEN term_year || '.0' WHEN 1 THEN 'n/a' ELSE CAST(term_year AS STRING) END"


@query(
    f"""+ o AS (SELECT case_number, {_DAY} AS date_issued, {_TERM} AS term_year FROM cases)
    SELECT case_number, date_issued, term_year FROM o""",
    CASES_SQL,
)
def orders_coerced(t: Tables) -> DataFrame:
    rows = t.cases.selectExpr("case_number", f"{_DAY} AS date_issued", f"{_TERM} AS term_year")
    return reports.orders_newest_first(rows)


@query("SELECT case_number, case_name FROM cases WHERE term_year = 1996 ORDER BY case_name, case_number", CASES_SQL)
def cases_of_year(t: Tables) -> DataFrame:
    return reports.cases_of_year(t.cases.select("case_number", "case_name", "term_year"), 1996).select("case_number", "case_name")


@query("SELECT s_suppkey AS id, s_name AS last_name FROM supplier ORDER BY s_suppkey % 40 <> 3, s_name")
def roster_order(t: Tables) -> DataFrame:
    rows = t.raw("supplier").selectExpr("s_suppkey AS id", "s_name AS last_name", "CASE WHEN s_suppkey % 40 = 3 THEN 'chief_justice' WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'associate_justice' END AS role")
    return votes.roster_order(rows).select("id", "last_name")


@query(
    """+ d AS (SELECT *, abs(dayofyear(date_issued) - dayofyear(DATE '2024-02-29')) AS apart FROM cases WHERE month(date_issued) NOT IN (2, 3)),
    best AS (SELECT month(date_issued) AS m, day(date_issued) AS dd FROM d ORDER BY least(apart, 366 - apart), date_issued DESC LIMIT 1)
    SELECT case_number, date_issued FROM d, best WHERE month(date_issued) = m AND day(date_issued) = dd""",
    CASES_SQL,
)
def nearest_day(t: Tables) -> DataFrame:
    rows = t.cases.where("month(date_issued) NOT IN (2, 3)").select("case_number", "date_issued")
    return reports.on_this_day(rows, dt.date(2024, 2, 29))


@query("SELECT l_orderkey AS case_number, max(l_linenumber * 1000000 + l_suppkey) AS last FROM lineitem GROUP BY l_orderkey")
def last_records(t: Tables) -> DataFrame:
    rows = t.raw("lineitem").selectExpr("l_orderkey AS case_number", "l_linenumber * 1000000 + l_suppkey AS last")
    return build.last_per_key(rows, "case_number", F.col("last"))


@query(
    """SELECT case_number, case_name, CASE WHEN starts_with(lower(case_name), 'state of new hampshire v.') THEN 'criminal' ELSE 'civil' END AS case_type, 'issued' AS outcome, '3JX Panel' AS vote_string, term_year,
    CASE WHEN case_number % 3 = 0 THEN NULL ELSE date_issued END AS date_issued, CASE WHEN case_number % 4 = 0 THEN '3jx_order' ELSE 'panel' END AS order_source
    FROM (SELECT docket AS case_number_, case_number, CASE WHEN case_number % 8 = 1 THEN 'State of New Hampshire v. ' || case_name ELSE case_name END AS case_name, term_year, date_issued FROM cases WHERE status = 'O' AND case_number % 7 <> 0)
    UNION ALL SELECT case_number, case_name, case_type, outcome, NULL, term_year, date_issued, 'case_order' FROM cases WHERE status <> 'O'""",
    CASES_SQL,
)
def panel_orders(t: Tables) -> DataFrame:
    """Panel orders as they are published, derived, aligned and put beside the case orders; placeholders go."""
    raw = t.cases.where("status = 'O'").selectExpr(
        "case_number", "CASE WHEN case_number % 7 = 0 THEN 'Request a Transcript' WHEN case_number % 8 = 1 THEN 'State of New Hampshire v. ' || case_name ELSE case_name END AS case_name", "term_year AS year",
        "CASE WHEN case_number % 3 = 0 THEN 'n/a' ELSE month(date_issued) || '/' || day(date_issued) || '/' || year(date_issued) END AS date_issued", "CASE WHEN case_number % 4 = 0 THEN NULL ELSE 'panel' END AS opinion_type",
    )
    panel = build.align_panel_orders(build.normalize_panel_orders(raw)).withColumn("case_number", F.col("case_number").cast("string"))
    rest = t.cases.where("status <> 'O'").select(F.col("case_number").cast("string").alias("case_number"), "case_name", "case_type", "outcome", "term_year", "date_issued")
    out = build.union_orders(rest, panel)
    return out.select(F.col("case_number").cast("long").alias("case_number"), "case_name", "case_type", "outcome", "vote_string", "term_year", "date_issued", "order_source")


# Text and stream ----------------------------------------------------------------------------------

STANDARDS = {"plain error": ["plain", "error"], "de novo": ["de", "novo"], "abuse of discretion": ["license", "rights"]}


@query(
    "SELECT doc_id, array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"regexp_matches(lower(coalesce(text, '')), '\\b{w}\\b')" for w in ws) + f" THEN '{k}' END" for k, ws in STANDARDS.items())
    + "], lambda x: x IS NOT NULL), ';') AS standards FROM documents"
)
def keyword_flags(t: Tables) -> DataFrame:
    return text.keyword_flags(t.raw("documents"), STANDARDS, "standards").select("doc_id", F.array_join("standards", ";").alias("standards"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def streaming_event_counts(t: Tables) -> DataFrame:
    """Counts of a stream of the events, in complete mode, after all of it has come."""
    rows, at = t.raw("events").select("event_id", "event_type"), t.folder("stream-counts")
    rows.repartition(4).write.parquet(f"{at}/incoming")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(f"{at}/incoming")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/counts")

    out = streaming_counts(stream, "event_type").writeStream.outputMode("complete").option("checkpointLocation", f"{at}/checkpoint")
    out.foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{at}/counts")
