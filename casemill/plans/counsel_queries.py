"""Counsel: appearances, firms under their usual name, win rates and parties without counsel, over derived appearance lines."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import counsel
from .bindings import Tables
from .queries import query

_LAWYER = "'Alex ' || substr('ABCDEFGHIJ', CAST(o_custkey % 10 + 1 AS INT), 1) || '. ' || c_mktsegment"
#: One firm in forty lines is misspelt, one in thirty has another ending.
_FIRM = "CASE WHEN o_orderkey % 40 = 7 THEN 'Ore & ' ELSE 'Orr & ' END || c_mktsegment || CASE WHEN o_orderkey % 30 = 2 THEN ' PLLC' ELSE ', P.A.' END"
LINES = {
    "case_number": "o_orderkey",
    "term_year": "CAST(year(o_orderdate) AS INT)",
    "outcome": "CASE o_orderkey % 6 WHEN 0 THEN 'affirmed' WHEN 1 THEN 'reversed' WHEN 2 THEN 'affirmed_and_remanded' WHEN 3 THEN 'dismissed' WHEN 4 THEN 'vacated' ELSE NULL END",
    "text": f"'No. ' || CAST(o_orderkey AS STRING) || chr(10) || CASE WHEN o_orderkey % 7 = 0 THEN 'John Doe, pro se, for the appellant.' ELSE {_FIRM} || ', of Concord (' || {_LAWYER} "
    "|| CASE WHEN o_orderkey % 2 = 0 THEN ' on the brief and orally' ELSE ' on the brief, and Kim Lee orally' END || '), for the appellant.' END || chr(10) "
    "|| 'Jane Roe, attorney general (Sam Poe, senior assistant attorney general, on the brief and orally), for the State.' || chr(10) || 'PER CURIAM. The brief (such as it was), for the record, is long.'",
}
_SEEN = f"""seen AS (SELECT o_orderkey AS case_number, {LINES['outcome']} AS outcome, {LINES['term_year']} AS term_year, o_orderkey % 7 = 0 AS alone, {_FIRM} AS firm, 'orr & ' || lower(c_mktsegment) AS known_as,
 {_LAWYER} AS lawyer, o_orderkey % 2 = 0 AS spoken FROM orders JOIN customer ON o_custkey = c_custkey),
rows_of AS (SELECT case_number, 1 AS line, firm, known_as, 'Concord' AS city, lawyer AS counsel, spoken AS orally, 'appellant' AS party, 'appellant' AS side, false AS pro_se FROM seen WHERE NOT alone
 UNION ALL SELECT case_number, 1, firm, known_as, 'Concord', 'Kim Lee', true, 'appellant', 'appellant', false FROM seen WHERE NOT alone AND NOT spoken
 UNION ALL SELECT case_number, 1, NULL, NULL, NULL, 'John Doe', false, 'appellant', 'appellant', true FROM seen WHERE alone
 UNION ALL SELECT case_number, 2, 'Jane Roe, attorney general', 'jane roe attorney general', NULL, 'Sam Poe', false, 'State', 'appellee', false FROM seen)"""


def _cases(t: Tables) -> DataFrame:
    o, c = t.raw("orders"), t.raw("customer")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"])
    return joined.selectExpr(*(f"{e} AS {k}" for k, e in LINES.items()))


@query("+ SELECT case_number, line, firm, city, counsel, orally, party, side, pro_se FROM rows_of", _SEEN)
def appearances(t: Tables) -> DataFrame:
    return counsel.appearances(_cases(t))


@query("+ SELECT firm, known_as FROM rows_of WHERE firm IS NOT NULL GROUP BY ALL", _SEEN)
def firm_names(t: Tables) -> DataFrame:
    """Every spelling of a firm under the plain form of its usual one."""
    return counsel.same_names(counsel.appearances(_cases(t)), "firm")


@query(
    """+ once AS (SELECT DISTINCT case_number, known_as, side, outcome FROM rows_of JOIN seen USING (case_number, known_as) UNION SELECT DISTINCT r.case_number, r.known_as, side, outcome FROM rows_of r JOIN seen s ON r.case_number = s.case_number WHERE r.line = 2)
    SELECT known_as, side, count(*) AS cases, count_if((side = 'appellant' AND outcome IN ('reversed', 'vacated')) OR (side = 'appellee' AND outcome IN ('affirmed', 'dismissed'))) AS won,
    count_if((side = 'appellee' AND outcome IN ('reversed', 'vacated')) OR (side = 'appellant' AND outcome IN ('affirmed', 'dismissed'))) AS lost, round(won / nullif(won + lost, 0), 4) AS win_rate FROM once GROUP BY known_as, side""",
    _SEEN,
)
def firm_win_rates(t: Tables) -> DataFrame:
    cases = _cases(t)
    rows = counsel.appearances(cases)
    named = rows.join(counsel.same_names(rows, "firm"), "firm", "left")
    return counsel.win_rates(named, cases, by="known_as")


@query("+ SELECT counsel, count(*) AS cases, count_if(spoke) AS spoke FROM (SELECT counsel, case_number, bool_or(orally) AS spoke FROM rows_of GROUP BY ALL) GROUP BY counsel ORDER BY cases DESC, counsel LIMIT 20", _SEEN)
def busiest_counsel(t: Tables) -> DataFrame:
    return counsel.busiest(counsel.appearances(_cases(t)))


@query("+ SELECT term_year, count(*) AS cases, count_if(alone) AS pro_se, round(count_if(alone) / count(*), 4) AS share FROM seen GROUP BY term_year", _SEEN)
def self_represented_share(t: Tables) -> DataFrame:
    cases = _cases(t)
    return counsel.self_represented(counsel.appearances(cases), cases)
