"""One query per report or operator, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean as N
from ..functions import constants as K
from ..operators import build, reports, search, text, transcripts, votes
from ..streaming.incremental import incremental_stream
from .bindings import APPOINTED_SQL, CASES_SQL, ROSTER_SQL, TURNS_SQL, VOTES_SQL, Tables

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None, *tables: str):
    """Register a function of ``Tables``; ``sql`` follows the common table expressions named."""

    def add(f: Callable[[Tables], DataFrame]):
        _queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            _sql[f.__name__] = f"WITH {', '.join(tables)}{',' if body.startswith('+') else ''} {body.lstrip('+')}" if tables else body
        return f

    return add


LABEL = "CASE outcome " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.OUTCOME_LABELS.items()) + " END"
TYPE_LABEL = "CASE lower(trim(case_type)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.CASE_TYPE_LABELS.items()) + " WHEN 'probate' THEN 'Probate' END"
BASE_LABELS = f"labelled AS (SELECT *, {LABEL} AS outcome_label FROM cases)"

# Distributions ----------------------------------------------------------------------------


@query(f"SELECT outcome, count(*) AS n, {LABEL} AS label FROM cases WHERE outcome IS NOT NULL GROUP BY outcome", CASES_SQL)
def outcome_distribution(t: Tables) -> DataFrame:
    return reports.outcome_distribution(t.cases)


@query("SELECT term_year, count(*) AS n FROM cases WHERE term_year BETWEEN 1996 AND 2000 GROUP BY term_year", CASES_SQL)
def cases_per_year(t: Tables) -> DataFrame:
    return reports.counts(reports.in_years(t.cases, 1996, 2000), "term_year")


@query("SELECT count(*) AS total, count_if(is_unanimous) AS unanimous, count_if(has_dissent) AS with_dissent, round(avg(days_to_decision), 4) AS mean_days FROM cases", CASES_SQL)
def term_headline(t: Tables) -> DataFrame:
    return reports.term_headline(t.cases)


@query(
    """SELECT m AS latest_term, count(*) AS total, count_if(term_year = m) AS in_latest,
    CAST(round_even(100.0 * sum(CASE WHEN is_unanimous THEN 1 ELSE 0 END) / count(*), 0) AS BIGINT) AS unanimous_pct, count_if(has_dissent) AS dissents
    FROM cases, (SELECT max(term_year) AS m FROM cases) GROUP BY m""",
    CASES_SQL,
)
def court_snapshot(t: Tables) -> DataFrame:
    return reports.court_snapshot(t.cases)


@query("SELECT count_if(involves_statutory_interpretation) AS n, count(*) AS total, round(count_if(involves_statutory_interpretation) / count(*), 4) AS share FROM cases", CASES_SQL)
def statutory_share(t: Tables) -> DataFrame:
    return reports.flag_share(t.cases, "involves_statutory_interpretation")


@query("SELECT case_type, count(*) AS n FROM cases WHERE opinion_type = 'case_order' AND case_type IS NOT NULL GROUP BY case_type", CASES_SQL)
def order_type_distribution(t: Tables) -> DataFrame:
    return reports.counts(reports.in_values(t.cases, opinion_type=["case_order"]), "case_type")


@query("SELECT count(*) AS total, min(term_year) AS first_year, max(term_year) AS last_year FROM cases", CASES_SQL)
def dataset_stats(t: Tables) -> DataFrame:
    return reports.dataset_stats(t.cases)


@query(
    """SELECT DISTINCT facet, value FROM (SELECT 'term_year' AS facet, CAST(term_year AS VARCHAR) AS value FROM cases UNION ALL SELECT 'outcome', outcome FROM cases
    UNION ALL SELECT 'author', author FROM cases UNION ALL SELECT 'case_type', case_type FROM cases) WHERE value IS NOT NULL""",
    CASES_SQL,
)
def facets(t: Tables) -> DataFrame:
    return reports.facets(t.cases, "term_year", "outcome", "author", "case_type")


@query("SELECT term_year, count(*) AS n FROM cases WHERE has_dissent GROUP BY term_year", CASES_SQL)
def dissents_per_year(t: Tables) -> DataFrame:
    return reports.counts(reports.by_decision(t.cases, "dissent"), "term_year")


# Means ------------------------------------------------------------------------------------


@query("SELECT term_year, round(avg(days_to_decision), 4) AS mean_days, count(*) AS n FROM cases WHERE days_to_decision IS NOT NULL GROUP BY term_year", CASES_SQL)
def decision_time_by_year(t: Tables) -> DataFrame:
    return reports.means(t.cases, "days_to_decision", "term_year", name="mean_days")


@query(
    f"""+ l AS (SELECT {TYPE_LABEL} AS label, word_count FROM cases)
    SELECT x.label, coalesce(round(avg(word_count), 4), 0.0) AS mean_words FROM (VALUES ('Civil'), ('Criminal'), ('Family/Domestic')) AS x(label) LEFT JOIN l USING (label) GROUP BY x.label""",
    CASES_SQL,
)
def words_by_case_type(t: Tables) -> DataFrame:
    return reports.words_by_case_type(t.cases)


@query("SELECT term_year, round(avg(word_count), 4) AS mean, count(*) AS n FROM cases GROUP BY term_year", CASES_SQL)
def words_by_year(t: Tables) -> DataFrame:
    return reports.means(t.cases, "word_count", "term_year")


@query("SELECT term_year, author, round(avg(word_count), 4) AS mean, count(*) AS n FROM cases WHERE author <> 'per_curiam' GROUP BY term_year, author", CASES_SQL)
def words_by_year_author(t: Tables) -> DataFrame:
    return reports.means(reports.by_author(t.cases), "word_count", "term_year", "author")


@query("SELECT author, round(avg(word_count), 4) AS mean, count(*) AS n FROM cases WHERE author <> 'per_curiam' GROUP BY author", CASES_SQL)
def words_by_author(t: Tables) -> DataFrame:
    return reports.means(reports.by_author(t.cases), "word_count", "author")


DISPLAY_SQL = "CASE author " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.DISPLAY.items()) + " END"


@query(f"SELECT author, count(*) AS n, {DISPLAY_SQL} AS label FROM cases WHERE author <> 'per_curiam' GROUP BY author", CASES_SQL)
def authorship(t: Tables) -> DataFrame:
    return reports.counts(reports.by_author(t.cases), "author").withColumn("label", N.justice_label(F.col("author")))


# Lists ------------------------------------------------------------------------------------

_ITEMS = "items AS (SELECT DISTINCT l_orderkey AS case_number, p_brand, p_type FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query("SELECT item, n FROM (SELECT p_brand AS item, count(DISTINCT case_number) AS n FROM items GROUP BY p_brand) ORDER BY n DESC, item LIMIT 10", _ITEMS)
def top_topics(t: Tables) -> DataFrame:
    return reports.exploded_counts(t.case_items, "topics", 10)


@query(
    "SELECT chapter, count(*) AS n FROM (SELECT trim(split_part(c, ':', 1)) AS chapter FROM (SELECT unnest(rsa_citations) AS c FROM cases)) GROUP BY chapter ORDER BY n DESC, chapter LIMIT 15",
    CASES_SQL,
)
def citation_chapters(t: Tables) -> DataFrame:
    return reports.citation_chapters(t.cases)


@query("SELECT item, count(*) AS n FROM (SELECT unnest(standard_of_review) AS item FROM cases) GROUP BY item", CASES_SQL)
def standard_of_review(t: Tables) -> DataFrame:
    return reports.exploded_counts(t.cases, "standard_of_review")


@query(f"SELECT outcome, count(*) AS n, {LABEL} AS label FROM cases WHERE list_has_any(topics, ['family_law', 'insurance']) AND outcome IS NOT NULL GROUP BY outcome", CASES_SQL)
def topic_filter_outcomes(t: Tables) -> DataFrame:
    return reports.outcome_distribution(reports.with_topics(t.cases, ["family_law", "insurance"]))


@query(
    "SELECT count(*) AS total, count_if(outcome = 'affirmed') AS affirmed, count_if(contains(outcome, 'revers')) AS reversed FROM cases WHERE len(list_filter(rsa_citations, lambda x: contains(lower(x), 'rsa 91-a'))) > 0",
    CASES_SQL,
)
def citation_metrics(t: Tables) -> DataFrame:
    return reports.citation_metrics(reports.citing(t.cases, "RSA 91-A"))


@query(
    "SELECT case_number FROM cases WHERE contains(lower(case_name), 'custody') OR contains(lower(coalesce(array_to_string(rsa_citations, ' | '), '')), 'custody') OR contains(lower(docket), 'custody')", CASES_SQL
)
def three_column_search(t: Tables) -> DataFrame:
    return reports.matching(t.cases, "Custody", ["case_name", "rsa_citations", "docket"]).select("case_number")


@query(
    """SELECT case_number, array_to_string(list_distinct_in_order, ';') AS citations, list_distinct_in_order[1] AS primary_citation FROM (
      SELECT case_number, list_filter(c, lambda x, i: list_position(c, x) = i) AS list_distinct_in_order FROM (
        SELECT case_number, list_transform(list_filter(list_transform(rsa_citations, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: NOT regexp_matches(x, '(?i)^RSA\\s+chapters?$')),
          lambda x: regexp_replace(x, '(?i)^RSA\\s+chapter\\s+(.+)$', 'RSA \\1')) AS c FROM cases WHERE rsa_citations IS NOT NULL))""",
    CASES_SQL,
)
def clean_citations(t: Tables) -> DataFrame:
    rows = t.cases.where("rsa_citations is not null").select("case_number", N.clean_citations(F.col("rsa_citations")).alias("c"))
    return rows.select("case_number", F.array_join("c", ";").alias("citations"), N.primary_citation(F.col("c"), F.lit(None).cast("string")).alias("primary_citation"))


# Cross-tabulations and pivots -----------------------------------------------------------------


@query("SELECT appeal_type, outcome, count(*) AS n FROM cases WHERE appeal_type IS NOT NULL AND outcome IS NOT NULL GROUP BY ALL", CASES_SQL)
def outcome_by_appeal_type(t: Tables) -> DataFrame:
    return reports.counts(t.cases, "appeal_type", "outcome")


@query("SELECT term_year, outcome, count(*) AS n FROM cases WHERE outcome IS NOT NULL GROUP BY ALL", CASES_SQL)
def outcome_by_year(t: Tables) -> DataFrame:
    return reports.counts(t.cases, "term_year", "outcome")


@query(
    """SELECT count(*) AS with_court, count_if(outcome = 'affirmed') AS affirmed, count_if(outcome IN ('reversed', 'reversed_and_remanded')) AS reversed, count(outcome) AS decided,
    round(100 * count_if(outcome = 'affirmed') / count(outcome), 4) AS affirmance_rate FROM cases WHERE lower_court IS NOT NULL""",
    CASES_SQL,
)
def court_headline(t: Tables) -> DataFrame:
    return reports.court_headline(t.cases)


def _by(key: str, least: int) -> str:
    return f"""+ {BASE_LABELS}, per AS (SELECT {key}, outcome_label, count(*) AS n FROM labelled WHERE outcome_label IS NOT NULL AND {key} IS NOT NULL GROUP BY ALL),
    totals AS (SELECT *, CAST(sum(n) OVER (PARTITION BY {key}) AS BIGINT) AS total FROM per) SELECT * FROM totals WHERE total >= {least}"""


@query(_by("court_type", 3), CASES_SQL)
def court_type_outcomes(t: Tables) -> DataFrame:
    return reports.outcomes_by(t.cases, "court_type", 3)


@query(_by("court_group", 3), CASES_SQL + ", grouped AS (SELECT *, CASE WHEN starts_with(court_type, 'Circuit Court') THEN 'Circuit Court' ELSE court_type END AS court_group FROM cases)".replace("grouped", "g0"))
def court_group_outcomes(t: Tables) -> DataFrame:
    return reports.outcomes_by(t.cases.withColumn("court_group", N.court_group(F.col("court_type"))), "court_group", 3)


_sql["court_group_outcomes"] = _sql["court_group_outcomes"].replace("AS outcome_label FROM cases)", "AS outcome_label FROM g0)")


@query(_by("judge", 5), CASES_SQL)
def judge_outcomes(t: Tables) -> DataFrame:
    return reports.outcomes_by(t.cases, "judge", 5)


_PIVOT = ", ".join(f"count_if(outcome_label = '{x}') AS {reports.column_name(x)}" for x in K.OUTCOME_ORDER)


@query(f"+ {BASE_LABELS} SELECT court_type, court, {_PIVOT}, count(*) AS total FROM labelled WHERE outcome_label IS NOT NULL GROUP BY court_type, court", CASES_SQL)
def court_pivot(t: Tables) -> DataFrame:
    return reports.outcome_pivot(t.cases, "court_type", "court").orderBy("court_type", F.desc("total"), "court")


@query(f"+ {BASE_LABELS} SELECT court, {_PIVOT}, count(*) AS total FROM labelled WHERE outcome_label IS NOT NULL AND starts_with(court_type, 'Circuit Court') GROUP BY court", CASES_SQL)
def circuit_pivot(t: Tables) -> DataFrame:
    return reports.outcome_pivot(t.cases.where(F.col("court_type").startswith("Circuit Court")), "court").orderBy(F.desc("total"), "court")


@query(
    f"""+ {BASE_LABELS}, wide AS (SELECT judge, {_PIVOT}, count(*) AS total FROM labelled WHERE outcome IS NOT NULL GROUP BY judge)
    SELECT *, round_even(100.0 * affirmed / total, 1) AS affirm_pct, round_even(100.0 * (reversed + reversed_and_remanded) / total, 1) AS reversal_pct FROM wide WHERE total >= 3""",
    CASES_SQL,
)
def judge_rates(t: Tables) -> DataFrame:
    return reports.judge_rates(t.cases, least=3)


_GROUP = """CASE WHEN case_type IN ('family/domestic', 'domestic/family', 'family', 'domestic') THEN 'family/domestic' WHEN case_type IN ('criminal', 'civil') THEN case_type
 WHEN list_has_any(topics, ['family_law', 'domestic_violence']) THEN 'family/domestic' WHEN list_contains(topics, 'criminal') THEN 'criminal'
 WHEN regexp_matches(telling, '(?i)^RSA\\s+(?:169-C|173-B|458|461-A)') THEN 'family/domestic' WHEN regexp_matches(telling, '(?i)^RSA\\s+(?:6\\d{2}|265-A)') THEN 'criminal' ELSE 'civil' END"""
_TELLING = "told AS (SELECT *, list_filter(rsa_citations, lambda x: regexp_matches(x, '(?i)^RSA\\s+(?:169-C|173-B|458|461-A|6\\d{2}|265-A)'))[1] AS telling FROM cases)"


@query(f"+ {_TELLING}, grouped AS (SELECT {_GROUP} AS case_group, outcome FROM told) SELECT case_group, outcome, count(*) AS n FROM grouped WHERE outcome IS NOT NULL GROUP BY ALL", CASES_SQL)
def case_groups(t: Tables) -> DataFrame:
    return reports.counts(t.cases.withColumn("case_group", N.case_group(F.col("case_type"), F.col("topics"), F.col("rsa_citations"))), "case_group", "outcome")


@query(
    f"""+ {_TELLING}, grouped AS (SELECT {_GROUP} AS case_group, case_number, date_issued FROM told),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY case_group ORDER BY date_issued DESC, case_number) AS r FROM grouped) SELECT case_group, case_number FROM ranked WHERE r <= 20""",
    CASES_SQL,
)
def case_group_heads(t: Tables) -> DataFrame:
    grouped = t.cases.withColumn("case_group", N.case_group(F.col("case_type"), F.col("topics"), F.col("rsa_citations")))
    return reports.first_per_group(grouped.select("case_group", "case_number", "date_issued"), "case_group", 20, F.desc("date_issued"), "case_number").select("case_group", "case_number")


@query("+ big AS (SELECT court FROM cases GROUP BY court HAVING count(*) >= 30) SELECT term_year, count(*) AS n FROM cases WHERE court IN (SELECT court FROM big) GROUP BY term_year", CASES_SQL)
def large_courts_per_year(t: Tables) -> DataFrame:
    return reports.counts(reports.at_least(t.cases, 30, "court"), "term_year")


# Votes ------------------------------------------------------------------------------------

_SUMMARY = """summary AS (SELECT case_number, count_if(vote = 'majority') AS majority, count_if(vote = 'dissent') AS dissent, count_if(vote = 'concur_separate') AS concur_separate,
 count_if(vote NOT IN ('majority', 'dissent', 'concur_separate')) AS not_participating FROM votes GROUP BY case_number)"""


@query(
    f"""+ {_SUMMARY} SELECT *, CASE WHEN majority + dissent + concur_separate > 0 THEN majority || '-' || dissent ELSE 'N/A' END AS vote_string,
    dissent = 0 AND majority + dissent + concur_separate > 0 AS is_unanimous, dissent > 0 AS has_dissent, concur_separate > 0 AS has_separate_concurrence FROM summary""",
    VOTES_SQL,
)
def vote_summary(t: Tables) -> DataFrame:
    return votes.vote_summary(t.votes)


@query(
    "SELECT case_number, 'donovan' AS justice_key, coalesce(vote, 'not_participating') AS vote FROM cases LEFT JOIN (SELECT case_number, vote FROM votes WHERE justice_key = 'donovan') USING (case_number)", CASES_SQL, VOTES_SQL
)
def vote_record(t: Tables) -> DataFrame:
    return votes.vote_record(t.cases, t.votes, "donovan")


@query(
    "+ every AS (SELECT case_number, justice_key FROM cases, roster) SELECT case_number, justice_key, coalesce(vote, 'not_participating') AS vote FROM every LEFT JOIN votes USING (case_number, justice_key)",
    CASES_SQL, VOTES_SQL, ROSTER_SQL,
)
def roster_votes(t: Tables) -> DataFrame:
    return votes.roster_votes(t.cases, t.votes, t.roster)


_SINCE = "(date_appointed IS NULL OR date_issued >= date_appointed)"


@query(
    f"""+ heard AS (SELECT v.justice_key, count_if(vote IN ('majority', 'dissent', 'concur_separate')) AS participated, count_if(vote = 'dissent') AS dissents, count_if(author = v.justice_key) AS authored_on_panel
      FROM votes v JOIN cases USING (case_number) JOIN appointed a ON a.justice_key = v.justice_key WHERE {_SINCE} GROUP BY v.justice_key),
    wrote AS (SELECT justice_key, count(*) AS authored FROM cases JOIN appointed ON author = justice_key WHERE {_SINCE} GROUP BY justice_key),
    base AS (SELECT r.justice_key, coalesce(participated, 0) AS participated, coalesce(dissents, 0) AS dissents, coalesce(authored_on_panel, 0) AS authored_on_panel, coalesce(authored, 0) AS authored
      FROM roster r LEFT JOIN heard h ON h.justice_key = r.justice_key LEFT JOIN wrote w ON w.justice_key = r.justice_key)
    SELECT *, round(100 * round(coalesce(authored / nullif(participated, 0), 0), 6), 2) AS authorship_pct, round(100 * round(coalesce(dissents / nullif(participated, 0), 0), 6), 2) AS dissent_pct FROM base""",
    CASES_SQL, VOTES_SQL, ROSTER_SQL, APPOINTED_SQL,
)
def justice_profile(t: Tables) -> DataFrame:
    return votes.justice_profile(t.cases, t.votes, t.appointed)


@query("SELECT vote, count(*) AS n FROM votes WHERE justice_key = 'gould' GROUP BY vote", VOTES_SQL)
def vote_distribution(t: Tables) -> DataFrame:
    return votes.vote_distribution(t.votes, "gould")


_PAIRS = """took AS (SELECT * FROM votes WHERE vote NOT IN ('not_participating', 'recused', 'disqualified')),
pairs AS (SELECT a.justice_key AS justice_1, b.justice_key AS justice_2, count(*) AS shared, count_if(a.vote = b.vote) AS agreed
 FROM took a JOIN took b ON a.case_number = b.case_number AND a.justice_key < b.justice_key GROUP BY ALL)"""


@query(f"+ {_PAIRS} SELECT *, round(agreed / shared, 4) AS agreement FROM pairs", VOTES_SQL)
def agreement_pairs(t: Tables) -> DataFrame:
    return votes.agreement_pairs(t.votes).orderBy(F.desc("agreement"), "justice_1", "justice_2")


@query(
    f"""+ {_PAIRS}, both_ways AS (SELECT justice_1, justice_2, round(agreed / shared, 4) AS a FROM pairs UNION ALL SELECT justice_2, justice_1, round(agreed / shared, 4) FROM pairs),
    every AS (SELECT x.justice_key AS justice_1, y.justice_key AS justice_2 FROM roster x, roster y)
    SELECT justice_1, justice_2, CASE WHEN justice_1 = justice_2 THEN 1.0::DOUBLE ELSE coalesce(a, 0.0)::DOUBLE END AS agreement FROM every LEFT JOIN both_ways USING (justice_1, justice_2)""",
    VOTES_SQL, ROSTER_SQL,
)
def agreement_matrix(t: Tables) -> DataFrame:
    return votes.agreement_matrix(t.votes, t.roster)


@query(
    "SELECT term_year, count_if(author = 'per_curiam') AS per_curiam, count(*) AS total, round(count_if(author = 'per_curiam') / count(*), 4) AS share FROM cases GROUP BY term_year HAVING count_if(author = 'per_curiam') > 0",
    CASES_SQL,
)
def per_curiam_share(t: Tables) -> DataFrame:
    return votes.per_curiam_share(t.cases)


@query(
    """+ seated AS (SELECT case_number, justice_key, row_number() OVER (PARTITION BY case_number ORDER BY list_position(['macdonald', 'donovan', 'hantz_marconi', 'countway', 'gould', 'will', 'bassett', 'hicks', 'lynn'], justice_key)) AS place FROM votes)
    SELECT case_number, justice_key, CAST(place AS INT) AS place FROM seated WHERE place <= 5""",
    VOTES_SQL,
)
def bench_seats(t: Tables) -> DataFrame:
    return votes.bench_seats(t.votes)


_VERDICT = """CASE WHEN regexp_matches(clause, '(?i)\\b(?:did not participate|not participat|recused|disqualified)\\b') THEN 'not_participating' WHEN regexp_matches(clause, '(?i)\\bconcurred\\s+specially\\b') THEN 'concur_separate'
 WHEN regexp_matches(clause, '(?i)\\bdissented\\b') THEN 'dissent' WHEN regexp_matches(clause, '(?i)\\bconcurred\\b') THEN 'majority' END"""


@query(
    f"""+ l AS (SELECT case_number, author, string_split(decision, chr(10)) AS ls FROM cases),
    segs AS (SELECT case_number, i AS at_, ls[i] AS seg FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM l) UNION ALL
      SELECT case_number, len(ls) + i, ls[i] || ' ' || ls[i + 1] FROM (SELECT *, unnest(range(1, len(ls))) AS i FROM l WHERE len(ls) > 1)),
    clauses AS (SELECT case_number, at_, p, string_split(seg, ';')[p] AS clause FROM (SELECT *, unnest(range(1, len(string_split(seg, ';')) + 1)) AS p FROM segs)),
    told AS (SELECT *, {_VERDICT} AS v FROM clauses), hits AS (SELECT case_number, justice_key, at_, p, trim(clause) AS note, v FROM told JOIN roster ON contains(upper(clause), last_name) WHERE v IS NOT NULL),
    firsts AS (SELECT case_number, justice_key, arg_min(v, at_ * 1000 + p) AS v, arg_min(note, at_ * 1000 + p) AS note, arg_max(note, at_ * 1000 + p) FILTER (WHERE v = 'not_participating') AS absent FROM hits GROUP BY ALL)
    SELECT c.case_number, r.justice_key, coalesce(f.v, CASE WHEN c.author = r.justice_key THEN 'majority' ELSE 'not_participating' END) AS vote, CASE WHEN f.v = 'not_participating' THEN f.absent ELSE f.note END AS note
    FROM cases c CROSS JOIN roster r LEFT JOIN firsts f ON f.case_number = c.case_number AND f.justice_key = r.justice_key""",
    CASES_SQL, ROSTER_SQL,
)
def vote_extraction(t: Tables) -> DataFrame:
    return votes.extract_votes(t.cases, t.roster, text="decision").select("case_number", "justice_key", "vote", "note")


# Order --------------------------------------------------------------------------------------


@query(
    """+ d AS (SELECT case_number, days_to_decision FROM cases WHERE days_to_decision IS NOT NULL) SELECT * FROM (SELECT *, 'fastest' AS kind FROM d ORDER BY days_to_decision, case_number LIMIT 5)
    UNION ALL SELECT * FROM (SELECT *, 'slowest' AS kind FROM d ORDER BY days_to_decision DESC, case_number LIMIT 5)""",
    CASES_SQL,
)
def fastest_slowest(t: Tables) -> DataFrame:
    return reports.fastest_slowest(t.cases)


@query("SELECT case_number, date_issued, term_year, outcome FROM cases", CASES_SQL)
def order_browser(t: Tables) -> DataFrame:
    return reports.newest_first(t.cases.select("case_number", "date_issued", "term_year", "outcome"), "date_issued", "term_year")


@query(
    """+ d AS (SELECT *, abs(dayofyear(date_issued) - dayofyear(DATE '2024-07-14')) AS apart FROM cases),
    best AS (SELECT month(date_issued) AS m, day(date_issued) AS dd FROM d ORDER BY CASE WHEN month(date_issued) = 7 AND day(date_issued) = 14 THEN -1 ELSE least(apart, 366 - apart) END, date_issued DESC LIMIT 1)
    SELECT case_number, date_issued FROM cases, best WHERE month(date_issued) = m AND day(date_issued) = dd""",
    CASES_SQL,
)
def on_this_day(t: Tables) -> DataFrame:
    return reports.on_this_day(t.cases, dt.date(2024, 7, 14)).select("case_number", "date_issued")


def _score_sql(words: list[str], whole: str, fields: dict[str, str], points: dict[str, int]) -> str:
    blob = "concat_ws(' ', " + ", ".join(fields.values()) + ")"
    parts = [f"CASE WHEN contains({blob}, '{whole}') THEN 12 ELSE 0 END"]
    for w in words:
        parts += [f"CASE WHEN contains({fields[f]}, '{w}') THEN {p} ELSE 0 END" for f, p in points.items()] + [f"CASE WHEN contains({blob}, '{w}') THEN 1 ELSE 0 END"]
    return " + ".join(parts)


_SEARCH = {"case_name": "lower(case_name)", "topics": "lower(coalesce(array_to_string(topics, ' '), ''))", "rsa_citations": "lower(coalesce(array_to_string(rsa_citations, ' '), ''))", "outcome": "lower(coalesce(outcome, ''))", "author": "lower(author)"}
_POINTS = {"case_name": 8, "topics": 5, "rsa_citations": 6}


@query(
    f"""+ s AS (SELECT case_number, date_issued, {_score_sql(['custody', 'and', 'evidence'][::2] + ['affirmed'], 'custody and evidence affirmed', _SEARCH, _POINTS)} AS score FROM cases)
    SELECT case_number, CAST(score AS INT) AS score FROM s WHERE score > 0 ORDER BY score DESC, date_issued DESC NULLS LAST, case_number LIMIT 20""",
    CASES_SQL,
)
def description_search(t: Tables) -> DataFrame:
    out = search.description_search(t.cases, "custody and evidence affirmed", 20, tuple(_SEARCH), _POINTS)
    return out.select("case_number", F.col("score").cast("int").alias("score"))


# Build --------------------------------------------------------------------------------------

_J = "\\([A-Za-z\\s.''‘’-]+,\\s*(?:C\\.J\\.|JJ\\.|J\\.)\\)"
COURT_SQL = f"""s1 AS (SELECT case_number, split_part(lower_court, chr(10), 1) AS s FROM cases),
s2 AS (SELECT case_number, regexp_replace(regexp_replace(s, '(?i)(?:Case\\s*No\\.?|Citation\\s*:|Order\\s*No\\.?|\\bNo\\.\\s*\\d{{4}}|\\d{{4}}-\\d{{4}}).*$', ''), '^(.*?{_J}).*$', '\\1') AS s FROM s1),
s3 AS (SELECT case_number, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(s, '\\([^()]*$', ''), '\\s+', ' ', 'g')), '[ ,;-]+$', ''), '(?i)^(?:the\\s+|l\\s+in\\s+|in\\s+)', '') AS s FROM s2),
s4 AS (SELECT case_number, s, regexp_extract(s, '^(?:[A-Z][A-Za-z]*(?:\\s+[A-Z][A-Za-z]*)*\\s+)?Superior\\s+Court(?:\\s+{_J})?', 0) AS sup FROM s3),
s5 AS (SELECT case_number, CASE WHEN regexp_matches(s, '(?i)u\\.?s\\.?\\s+district\\s+court') THEN 'U.S. District Court' WHEN regexp_matches(s, '(?i)superior\\s+court') THEN CASE WHEN sup = '' THEN 'Superior Court' ELSE sup END
 WHEN s <> '' AND NOT contains(lower(s), 'court') THEN NULL ELSE nullif(s, '') END AS court FROM s4)"""


@query(
    f"""+ {COURT_SQL}, b AS (SELECT case_number, court, trim(split_part(trim(regexp_replace(court, '\\s*{_J}\\s*$', '')), ';', 1)) AS b0, nullif(trim(regexp_extract(court, '\\(([A-Za-z\\s.''‘’-]+),\\s*(?:C\\.J\\.|JJ\\.|J\\.)\\)', 1)), '') AS judge FROM s5),
    c AS (SELECT *, CASE WHEN contains(lower(b0), 'family court') AND NOT contains(lower(b0), 'circuit') THEN 'Family Court' ELSE b0 END AS base FROM b)
    SELECT case_number, court, base, judge, CASE WHEN contains(lower(base), 'circuit') THEN CASE WHEN contains(lower(base), 'family') THEN 'Circuit Court – Family Division' WHEN contains(lower(base), 'district') THEN 'Circuit Court – District Division'
      WHEN contains(lower(base), 'probate') THEN 'Circuit Court – Probate Division' ELSE 'Circuit Court' END WHEN contains(lower(base), 'superior') THEN 'Superior Court' WHEN contains(lower(base), 'probate') THEN 'Probate Court' ELSE base END AS kind FROM c""",
    CASES_SQL,
)
def normalize_courts(t: Tables) -> DataFrame:
    rows = t.cases.select("case_number", N.normalize_court(F.col("lower_court")).alias("court"))
    rows = rows.withColumns({"base": N.court_base(F.col("court")), "judge": N.court_judge(F.col("court"))})
    return rows.withColumn("kind", N.court_type(F.col("base")))


_MARKS = "list_transform(list_filter(rsa_citations, lambda x: regexp_matches(lower(x), 'rsa\\s+[0-9]')), lambda x: regexp_extract(lower(x), 'rsa\\s+([0-9]+(?:-[a-z])?)', 1))"
_FAM = "['" + "', '".join(K.FAMILY_CHAPTERS) + "']"
_CRIM = "['" + "', '".join(K.CRIMINAL_CHAPTERS) + "']"
_WORDS = "|".join(K.FAMILY_WORDS)
_INITIALS = "^[A-Z]\\.[A-Z]\\.\\s+v\\.\\s+[A-Z]\\.[A-Z]\\."
INFER_SQL = f"""marked AS (SELECT *, coalesce(list_has_any({_MARKS}, {_FAM}), false) AS fam, coalesce(list_has_any({_MARKS}, {_CRIM}), false) AS crim FROM cases),
guessed AS (SELECT *, CASE WHEN regexp_matches(lower(case_name), '^state(?:\\s+of\\s+new\\s+hampshire)?\\s+v\\.\\s+') THEN 'state_v_case_name' WHEN regexp_matches(lower(case_name), '{_WORDS}') THEN 'family_keyword_case_name'
 WHEN fam AND NOT crim THEN 'family_rsa_marker' WHEN crim AND NOT fam THEN 'criminal_rsa_marker' WHEN regexp_matches(case_name, '{_INITIALS}') THEN 'initials_case_name_pattern' ELSE 'insufficient_signals' END AS reason FROM marked),
inferred AS (SELECT case_number, case_name, reason, CASE reason WHEN 'state_v_case_name' THEN 'criminal' WHEN 'criminal_rsa_marker' THEN 'criminal' WHEN 'insufficient_signals' THEN NULL ELSE 'family/domestic' END AS case_type,
 CASE reason WHEN 'state_v_case_name' THEN 'high' WHEN 'family_keyword_case_name' THEN 'high' WHEN 'initials_case_name_pattern' THEN 'low' WHEN 'insufficient_signals' THEN 'none' ELSE 'medium' END AS confidence FROM guessed)"""


@query(f"+ {INFER_SQL} SELECT case_number, case_type, confidence, reason FROM inferred", CASES_SQL)
def infer_case_type(t: Tables) -> DataFrame:
    return t.cases.select("case_number", N.infer_case_type(F.col("case_name"), F.col("rsa_citations")).alias("g")).select("case_number", "g.*")


def _inferred(t: Tables) -> DataFrame:
    rows = t.cases.select("case_number", "case_name", "opinion_type", N.infer_case_type(F.col("case_name"), F.col("rsa_citations")).alias("g"))
    return rows.select("case_number", "case_name", "opinion_type", F.col("g.case_type").alias("case_type"), F.col("g.confidence").alias("inference_confidence"), F.col("g.reason").alias("inference_reason"), F.lit(True).alias("case_type_was_null"))


_GENERATED = """generated AS (SELECT case_number, case_name, CASE WHEN regexp_matches(lower(case_name), '\\bv\\.\\s+state\\s+of\\s+new\\s+hampshire\\b') THEN 'criminal' WHEN starts_with(lower(case_name), 'in the matter of ') THEN 'family/domestic' ELSE 'civil' END AS override_case_type,
 CASE WHEN starts_with(lower(case_name), 'in the matter of ') THEN 'default_in_the_matter_of' WHEN regexp_matches(lower(case_name), '\\bv\\.\\s+state\\s+of\\s+new\\s+hampshire\\b') THEN 'default_v_state_caption' ELSE 'default_fallback_civil' END AS override_reason FROM inferred WHERE case_type IS NULL)"""
_EXISTING = "existing AS (SELECT case_number, case_name, CASE case_number % 3 WHEN 0 THEN '' WHEN 1 THEN 'civil' ELSE 'wrong' END AS override_case_type, CASE case_number % 2 WHEN 0 THEN NULL ELSE 'by hand' END AS override_reason FROM cases WHERE status = 'P')"


def _existing_overrides(t: Tables) -> DataFrame:
    return t.cases.where("status = 'P'").selectExpr(
        "CAST(case_number AS STRING) AS case_number", "case_name", "CASE case_number % 3 WHEN 0 THEN '' WHEN 1 THEN 'civil' ELSE 'wrong' END AS override_case_type", "CASE case_number % 2 WHEN 0 THEN NULL ELSE 'by hand' END AS override_reason"
    )


def _as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("case_number", F.col("case_number").cast("string"))


_MERGED = """merged AS (SELECT CAST(coalesce(e.case_number, g.case_number) AS VARCHAR) AS case_number, coalesce(nullif(e.case_name, ''), g.case_name, '') AS case_name,
 coalesce(nullif(e.override_case_type, ''), g.override_case_type, '') AS override_case_type, coalesce(nullif(e.override_reason, ''), g.override_reason, '') AS override_reason FROM existing e FULL JOIN generated g ON e.case_number = g.case_number)"""


@query(f"+ {INFER_SQL}, {_GENERATED}, {_EXISTING}, {_MERGED} SELECT * FROM merged", CASES_SQL)
def override_upsert(t: Tables) -> DataFrame:
    return build.override_upsert(_existing_overrides(t), build.generated_overrides(_as_text(_inferred(t))))


_BY_HAND = "CASE case_number % 4 WHEN 0 THEN '' WHEN 1 THEN ' Civil ' WHEN 2 THEN 'wrong' ELSE 'family/domestic' END"


@query(
    f"""+ {INFER_SQL}, valid AS (SELECT case_number, lower(trim({_BY_HAND})) AS override_case_type FROM cases WHERE opinion_type = 'case_order' AND case_number % 4 IN (1, 3))
    SELECT CAST(i.case_number AS VARCHAR) AS case_number, coalesce(v.override_case_type, i.case_type) AS case_type, CASE WHEN v.case_number IS NOT NULL THEN 'manual' ELSE i.confidence END AS inference_confidence,
    CASE WHEN v.case_number IS NOT NULL THEN 'manual_override_table' ELSE i.reason END AS inference_reason FROM inferred i LEFT JOIN valid v ON v.case_number = i.case_number""",
    CASES_SQL,
)
def override_apply(t: Tables) -> DataFrame:
    """Overrides of all cases, opinions too; only those of case orders count."""
    by_hand = _as_text(t.cases).selectExpr("' ' || case_number AS case_number", f"{_BY_HAND} AS override_case_type".replace("case_number %", "CAST(case_number AS BIGINT) %"))
    return build.override_apply(_as_text(_inferred(t)), by_hand).select("case_number", "case_type", "inference_confidence", "inference_reason")


@query(f"+ {INFER_SQL} SELECT case_number, case_type, confidence AS inference_confidence FROM inferred WHERE case_type IS NULL OR confidence IN ('low', 'medium', 'none')", CASES_SQL)
def review_queue(t: Tables) -> DataFrame:
    return build.review_queue(_inferred(t)).select("case_number", "case_type", "inference_confidence")


@query(
    """SELECT case_number, case_name, CAST(NULL AS VARCHAR) AS outcome, term_year FROM cases WHERE status = 'O' UNION ALL SELECT case_number, case_name, outcome, term_year FROM cases WHERE status <> 'O'""", CASES_SQL
)
def union_orders(t: Tables) -> DataFrame:
    columns = ["case_number", "case_name", "outcome", "term_year"]
    rest = t.cases.where("status <> 'O'").select(*columns).withColumn("case_number", F.col("case_number").cast("string"))
    panel = t.cases.where("status = 'O'").select("case_number", "case_name", "term_year").withColumn("case_number", F.col("case_number").cast("string"))
    return build.union_orders(rest, panel).select(F.col("case_number").cast("long").alias("case_number"), "case_name", "outcome", "term_year")


@query("SELECT o_orderkey AS case_number, 'orders/' || o_orderkey || '.pdf' AS local_path FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_files(t: Tables) -> DataFrame:
    path = lambda c: F.concat(F.lit("orders/"), F.col(c).cast("string"), F.lit(".pdf")).alias("local_path")
    expected = t.raw("orders").select(F.col("o_orderkey").alias("case_number"), path("o_orderkey"))
    return build.missing_files(expected, t.raw("lineitem").select(path("l_orderkey"))).select("case_number", "local_path")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id % 4 <> 0")
def incremental_new(t: Tables) -> DataFrame:
    rows = t.raw("events").select("event_id", "user_id", "event_type")
    return build.new_records(rows, rows.where("event_id % 4 = 0"), "event_id")


@query("SELECT case_number, CASE WHEN case_number % 10 = 0 AND term_year > 1997 THEN 'vacated' ELSE outcome END AS outcome FROM cases", CASES_SQL)
def corrections(t: Tables) -> DataFrame:
    manual = t.cases.where("case_number % 10 = 0 AND term_year > 1997").select("case_number", F.lit("vacated").alias("outcome"))
    return build.corrections(t.cases.select("case_number", "outcome"), manual, "outcome")


@query("SELECT case_number, case_number IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS has_opinion FROM cases", CASES_SQL)
def orders_crossref(t: Tables) -> DataFrame:
    opinions = t.raw("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("case_number"))
    return build.cross_reference(t.cases.select("case_number"), opinions)


# Text ---------------------------------------------------------------------------------------

TAXONOMY = {"english": ["the ", "ing "], "license": ["license", "all rights reserved"], "shouting": ["!!"], "markup": ["<", "|"]}


@query(
    "SELECT doc_id, array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{k}' END" for k, ws in TAXONOMY.items())
    + "], lambda x: x IS NOT NULL), ';') AS topics FROM documents"
)
def topic_tagging(t: Tables) -> DataFrame:
    return text.topic_tags(t.raw("documents"), TAXONOMY).select("doc_id", F.array_join("topics", ";").alias("topics"))


@query("SELECT case_number, 'RSA ' || (case_number % 700) || ':' || (case_number % 9 + 1) || ', II;RSA 91-A' AS citations FROM cases".replace(";RSA 91-A", ""), CASES_SQL)
def citation_extraction(t: Tables) -> DataFrame:
    return t.cases.select("case_number", F.array_join(text.extract_citations(F.col("opinion")), ";").alias("citations"))


@query(
    """SELECT case_number, docket AS number, (1990 + case_number % 30) || ' N.H. ' || (case_number % 90 + 1) AS citation, CAST(1990 + case_number % 30 AS INT) AS citation_year, CAST(case_number % 90 + 1 AS INT) AS citation_seq,
    make_date(2021, 3, CAST(case_number % 28 + 1 AS INT)) AS date_argued, CASE WHEN case_number % 2 = 0 THEN 'PER CURIAM' ELSE 'DONOVAN, J.' END AS author_line,
    CASE case_number % 3 WHEN 0 THEN 'affirmed' WHEN 1 THEN 'reversed_and_remanded' END AS outcome FROM cases""",
    CASES_SQL,
)
def header_extraction(t: Tables) -> DataFrame:
    rows = t.cases.select("case_number", text.extract_header(F.col("opinion")).alias("h"), text.outcome_verb(F.col("opinion")).alias("outcome"))
    return rows.select("case_number", F.col("h.case_number").alias("number"), "h.citation", "h.citation_year", "h.citation_seq", "h.date_argued", "h.author_line", "outcome")


@query(
    """SELECT 'u' || case_number AS url, docket AS case_number, case_name, NULL::VARCHAR AS citation FROM cases WHERE status = 'F'
    UNION ALL SELECT 'u' || case_number, '1999-' || lpad(CAST(case_number % 10000 AS VARCHAR), 4, '0'), case_name, NULL FROM cases WHERE status = 'F'
    UNION ALL SELECT 'u' || case_number, NULL, case_name, (1990 + case_number % 30) || ' N.H. 7' FROM cases WHERE status = 'O'
    UNION ALL SELECT 'u' || case_number, CASE WHEN case_number % 2 = 0 THEN NULL ELSE docket END, case_name, '2025 N.H. 54' FROM cases WHERE status = 'P'""",
    CASES_SQL,
)
def link_harmonise(t: Tables) -> DataFrame:
    first = t.cases.where("status = 'F'").selectExpr("'u' || case_number AS url", "docket || ', ' || case_name || '; 1999-' || lpad(CAST(case_number % 10000 AS STRING), 4, '0') || ', ' || case_name AS text")
    second = t.cases.where("status = 'O'").selectExpr("'u' || case_number AS url", "(1990 + case_number % 30) || ' N.H. 7, ' || case_name AS case_name")
    third = t.cases.where("status = 'P'").selectExpr("'u' || case_number AS pdf_url", "CASE WHEN case_number % 2 = 0 THEN ' ' ELSE docket END AS case_number", "case_name", "'2025 N.H. 54' AS citation", "2025 AS year")
    return text.harmonise_links(text.link_text(first), text.link_citation(second), text.link_structured(third))


# Transcripts --------------------------------------------------------------------------------

_STATS = """seg AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w, text AS same FROM turns),
dup AS (SELECT case_number, CAST(sum(k - 1) AS BIGINT) AS duplicate_segment_instances FROM (SELECT case_number, same, count(*) AS k FROM seg GROUP BY ALL) GROUP BY case_number),
base AS (SELECT case_number, count(*) AS segment_count, CAST(sum(w) AS BIGINT) AS word_count, CAST(sum(length(text)) AS BIGINT) AS character_count, round(avg(w), 4) AS avg_words_per_segment, round(quantile_cont(w, 0.5), 4) AS median_words_per_segment,
 CAST(quantile_disc(w, 0.9) AS BIGINT) AS p90_words_per_segment, round(avg(length(text)), 4) AS avg_chars_per_segment, round(quantile_cont(length(text), 0.5), 4) AS median_chars_per_segment,
 CAST(max(w) AS BIGINT) AS max_segment_words, count_if(w >= 100) AS long_segment_count, count_if(w >= 200) AS very_long_segment_count, count_if(contains(text, '?')) AS question_segment_count,
 CAST(sum(length(text) - length(replace(text, '?', ''))) AS BIGINT) AS question_mark_count, CAST(sum(length(text) - length(replace(text, '!', ''))) AS BIGINT) AS exclamation_mark_count,
 CAST(max(turn) * 30 + 30 AS DOUBLE) AS duration_seconds, count_if(speaker = 'Justice') AS justice_segments, count_if(speaker = 'Counsel') AS counsel_segments FROM seg GROUP BY case_number),
stats AS (SELECT *, round(long_segment_count / segment_count, 4) AS long_segment_ratio, round(duplicate_segment_instances / segment_count, 4) AS repeated_segment_ratio, round(word_count / (duration_seconds / 60), 4) AS words_per_minute,
 round(segment_count / (duration_seconds / 60), 4) AS segments_per_minute, round(question_mark_count / (duration_seconds / 60), 4) AS questions_per_minute, round(justice_segments / segment_count, 4) AS justice_guess_ratio,
 round(counsel_segments / segment_count, 4) AS counsel_guess_ratio FROM base JOIN dup USING (case_number))"""


def _stats(t: Tables) -> DataFrame:
    return transcripts.transcript_stats(t.turns, seconds=F.max("turn") * 30 + 30)


@query(f"+ {_STATS} SELECT * FROM stats", TURNS_SQL)
def transcript_stats(t: Tables) -> DataFrame:
    return _stats(t)


_OPEN = "opening AS (SELECT case_number, min(turn) FILTER (WHERE contains(lower(text), 'ing the') OR contains(lower(text), 'de la')) AS opening_counsel_index FROM turns GROUP BY case_number)"


def _opening(t: Tables) -> DataFrame:
    return transcripts.opening_position(t.turns, ["ing the", "de la"], segment="turn")


@query(f"+ {_OPEN} SELECT * FROM opening", TURNS_SQL)
def opening_position(t: Tables) -> DataFrame:
    return _opening(t)


_WINDOWS = """ws AS (SELECT case_number, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM turns),
grams AS (SELECT case_number, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM ws WHERE len(w) >= 3)),
again AS (SELECT case_number, CAST(sum(k - 1) AS BIGINT) AS r FROM (SELECT case_number, g, count(*) AS k FROM grams GROUP BY ALL) GROUP BY case_number),
windows AS (SELECT case_number, word_count, coalesce(r, 0) AS repeated_window_count, round(coalesce(coalesce(r, 0) / nullif(word_count, 0), 0), 6) AS repeated_window_density
 FROM (SELECT case_number, CAST(sum(len(w)) AS BIGINT) AS word_count FROM ws GROUP BY case_number) LEFT JOIN again USING (case_number))"""


@query(f"+ {_WINDOWS} SELECT * FROM windows", TURNS_SQL)
def repeated_windows(t: Tables) -> DataFrame:
    return transcripts.repeated_windows(t.turns, 3)


_SCORED = f"""{_STATS}, {_OPEN}, {_WINDOWS}, joined AS (SELECT s.case_number, opening_counsel_index AS i, repeated_segment_ratio AS r, repeated_window_density AS d FROM stats s JOIN opening USING (case_number) JOIN windows USING (case_number)),
scored AS (SELECT case_number, i, CAST(100 - CASE WHEN i IS NULL THEN 25 WHEN i >= 8 THEN 10 ELSE 0 END - CASE WHEN r >= 0.03 THEN 12 WHEN r >= 0.015 OR d >= 0.01 THEN 6 ELSE 0 END AS INT) AS operational_quality_score FROM joined),
ranked AS (SELECT *, CASE WHEN operational_quality_score < 70 THEN 'high' WHEN operational_quality_score <= 90 THEN 'medium' ELSE 'low' END AS review_priority FROM scored)"""


def _scored(t: Tables) -> DataFrame:
    stats = _stats(t).drop("word_count").join(_opening(t), "case_number").join(transcripts.repeated_windows(t.turns, 3), "case_number")
    return transcripts.quality_score(stats)


@query(
    f"""+ {_SCORED} SELECT case_number, operational_quality_score, review_priority, CASE review_priority WHEN 'high' THEN 'review-and-consider-turbo-rerun' WHEN 'medium' THEN 'review-opening' ELSE 'accept-default' END AS recommendation,
    i IS NULL OR i >= 60 AS rerun_turbo_recommended FROM ranked""",
    TURNS_SQL,
)
def quality_score(t: Tables) -> DataFrame:
    return _scored(t).select("case_number", "operational_quality_score", "review_priority", "recommendation", "rerun_turbo_recommended")


@query(f"+ {_SCORED} SELECT case_number, operational_quality_score FROM ranked WHERE operational_quality_score < 90", TURNS_SQL)
def review_list(t: Tables) -> DataFrame:
    return transcripts.review_list(_scored(t), 90).select("case_number", "operational_quality_score")


@query(
    """SELECT stage, status, count(*) AS n FROM (SELECT 'download' AS stage, CASE WHEN event_id % 3 = 0 THEN 'complete' ELSE 'pending' END AS status FROM events
    UNION ALL SELECT 'transcription', CASE WHEN event_id % 5 = 0 THEN 'complete' ELSE 'pending' END FROM events) GROUP BY ALL"""
)
def stage_rollup(t: Tables) -> DataFrame:
    done = lambda n: f"named_struct('status', CASE WHEN event_id % {n} = 0 THEN 'complete' END)"
    return transcripts.stage_rollup(t.raw("events").selectExpr(f"{done(3)} AS download", f"{done(5)} AS transcription"), ("download", "transcription"))


@query(
    """+ f AS (SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY case_number ORDER BY turn) THEN 1 ELSE 0 END AS fresh FROM turns),
    p AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY case_number ORDER BY turn) AS BIGINT) AS paragraph FROM f)
    SELECT case_number, paragraph, min(speaker) AS speaker, count(*) AS turns, string_agg(text, ' ' ORDER BY turn) AS text FROM p GROUP BY case_number, paragraph""",
    TURNS_SQL,
)
def merge_turns(t: Tables) -> DataFrame:
    return transcripts.merge_turns(t.turns)


@query(
    """+ pairs AS (SELECT unnest([docket, '1900-' || right(docket, 4)]) AS docket, date_issued AS argued, case_name FROM cases WHERE status <> 'O'), tr AS (SELECT docket, argued, case_name AS name FROM pairs),
    op AS (SELECT docket, CASE WHEN case_number % 4 = 0 THEN NULL ELSE date_issued END AS argued, CASE WHEN case_number % 5 = 0 THEN 'Zq & Co.' ELSE upper(case_name) || '.' END AS name FROM cases WHERE status <> 'F')
    SELECT docket, CASE WHEN tr.docket IS NULL THEN 'opinion-only' WHEN op.docket IS NULL THEN 'transcript-only' ELSE 'both' END AS link_state,
    CASE WHEN tr.docket IS NOT NULL AND op.docket IS NOT NULL THEN tr.argued IS DISTINCT FROM op.argued END AS date_mismatch,
    CASE WHEN tr.docket IS NOT NULL AND op.docket IS NOT NULL THEN 3 * levenshtein(regexp_replace(lower(tr.name), '[^a-z0-9]+', ' ', 'g'), regexp_replace(lower(op.name), '[^a-z0-9]+', ' ', 'g'))
      > greatest(length(regexp_replace(lower(tr.name), '[^a-z0-9]+', ' ', 'g')), length(regexp_replace(lower(op.name), '[^a-z0-9]+', ' ', 'g'))) END AS name_mismatch FROM tr FULL JOIN op USING (docket)""",
    CASES_SQL,
)
def transcript_link(t: Tables) -> DataFrame:
    tr = t.cases.where("status <> 'O'").selectExpr("docket || '-1900-' || right(docket, 4) AS docket", "date_issued AS argument_date", "case_name")
    op = t.cases.where("status <> 'F'").selectExpr("docket", "CASE WHEN case_number % 4 = 0 THEN NULL ELSE date_issued END AS date_argued", "CASE WHEN case_number % 5 = 0 THEN 'Zq & Co.' ELSE upper(case_name) || '.' END AS case_name")
    return transcripts.transcript_link(tr, op, "docket").select("docket", "link_state", "date_mismatch", "name_mismatch")


# Streaming ----------------------------------------------------------------------------------


@query(None)
def incremental_stream_load(t: Tables) -> DataFrame:
    """Load the events as a stream into a table that already has every fourth of them."""
    spark = t.spark
    at = t.folder("stream")
    rows = t.raw("events").select("event_id", "user_id", "event_type")
    rows.where("event_id % 4 = 0").write.parquet(f"{at}/target")
    rows.repartition(4).write.parquet(f"{at}/incoming")
    incremental_stream(spark, f"{at}/incoming", f"{at}/target", rows.schema, f"{at}/checkpoint", "event_id").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/target")


_sql["incremental_stream_load"] = "SELECT event_id, user_id, event_type FROM events"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
