"""Court-shaped tables derived from the order tables, as expression text that Spark and DuckDB both read.

Only integer arithmetic and existing strings are used, so both engines derive the same values.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..functions import constants as K

_AUTHORS = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate((*K.ROSTER, "per_curiam")))
_OUTCOMES = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(("affirmed", "reversed", "remanded", "reversed_and_remanded", "vacated", "dismissed", "affirmed_and_remanded")))
_DOCKET = "CAST(CAST(2000 + floor(o_orderkey / 10000) AS BIGINT) AS STRING) || '-' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')"

CASES = {
    "case_number": "o_orderkey",
    "docket": _DOCKET,
    "case_name": "CASE o_orderkey % 10 WHEN 0 THEN 'State v. ' || c_name WHEN 1 THEN 'In the Matter of ' || c_name WHEN 2 THEN 'A.B. v. C.D.' "
    "WHEN 3 THEN c_name || ' v. State of New Hampshire' WHEN 4 THEN 'Custody of ' || c_name ELSE c_name || ' v. ' || n_name END",
    "date_issued": "CAST(o_orderdate AS DATE)",
    "term_year": "CAST(year(o_orderdate) AS INT)",
    "outcome": f"CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CASE o_orderkey % 7 {_OUTCOMES} END END",
    "author": f"CASE o_custkey % 10 {_AUTHORS} END",
    "lower_court": "CASE o_orderkey % 9 WHEN 0 THEN c_mktsegment || ' Superior Court (Smith, J.) Case No. 12' WHEN 1 THEN 'the ' || c_mktsegment || ' Superior Court (O''Neil, J.), 2019-0123' "
    "WHEN 2 THEN '3rd Circuit Court - ' || c_mktsegment || ' Family Division (Jones, C.J.); see order' WHEN 3 THEN 'U.S. District Court for ' || c_mktsegment "
    "WHEN 4 THEN 'in  ' || c_mktsegment || ' Probate Court (Brown' WHEN 5 THEN 'no place named here' WHEN 6 THEN '10th Circuit Court - District Division' || chr(10) || 'line two' "
    "WHEN 7 THEN 'Derry Family Court' ELSE NULL END",
    "judge": "c_mktsegment",
    "court": "n_name",
    "court_type": "CASE r_regionkey WHEN 0 THEN 'Circuit Court' WHEN 1 THEN 'Circuit Court – Family Division' WHEN 2 THEN 'Superior Court' WHEN 3 THEN 'Probate Court' ELSE r_name END",
    "appeal_type": "o_orderpriority",
    "days_to_decision": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 400 AS INT) END",
    "word_count": "CAST(floor(o_totalprice) AS BIGINT)",
    "case_type": "CASE o_orderkey % 6 WHEN 0 THEN 'criminal' WHEN 1 THEN 'civil' WHEN 2 THEN 'family/domestic' WHEN 3 THEN 'domestic' WHEN 4 THEN 'probate' ELSE NULL END",
    "is_unanimous": "o_orderkey % 3 = 0",
    "has_dissent": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 5 = 1 END",
    "involves_statutory_interpretation": "o_orderkey % 4 = 1",
    "topics": "CASE o_orderkey % 5 WHEN 0 THEN split('criminal;evidence', ';') WHEN 1 THEN split('family_law', ';') WHEN 2 THEN split('evidence;insurance;contracts', ';') WHEN 3 THEN NULL ELSE split('criminal;family_law', ';') END",
    "rsa_citations": "CASE o_orderkey % 8 WHEN 0 THEN split('RSA 458:7;RSA 461-A:6', ';') WHEN 1 THEN split('RSA 631:2;RSA 625:4;RSA 631:2', ';') WHEN 2 THEN split('RSA chapter 318-B;RSA  318-B:2', ';') "
    "WHEN 3 THEN split('RSA chapter', ';') WHEN 4 THEN split('RSA 91-A:5;RSA 91-A:8, IV;RSA 91-A:5', ';') WHEN 5 THEN split('RSA 541-A:31;RSA 169-C:3', ';') ELSE NULL END",
    "standard_of_review": "CASE o_orderkey % 4 WHEN 0 THEN split('de novo', ';') WHEN 1 THEN split('plain error;abuse of discretion', ';') ELSE NULL END",
    "opinion_type": "CASE WHEN o_orderstatus = 'F' THEN 'opinion' ELSE 'case_order' END",
    "status": "o_orderstatus",
    "decision": "'AFFIRMED.' || chr(10) || CASE o_orderkey % 4 WHEN 0 THEN 'DONOVAN, BASSETT, and HICKS, JJ., concurred; HANTZ MARCONI, J., dissented.' WHEN 1 THEN 'BASSETT, J., concurred specially; LYNN, C.J., did not' || chr(10) || 'participate.' "
    "WHEN 2 THEN 'The clerk will file this.' || chr(10) || 'GOULD and COUNTWAY, JJ., concurred;' || chr(10) || 'WILL, J., sat but was disqualified.' ELSE 'All concurred.' || chr(10) || 'HICKS, J., dissented, and DONOVAN, J.,' || chr(10) || 'concurred.' END",
    "opinion": f"'Case No. ' || {_DOCKET} || chr(10) || 'Citation: ' || CAST(1990 + o_orderkey % 30 AS STRING) || ' N.H. ' || CAST(o_orderkey % 90 + 1 AS STRING) || chr(10) || 'Argued: March ' || CAST(o_orderkey % 28 + 1 AS STRING) || ', 2021' "
    "|| chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN 'PER CURIAM. ' ELSE 'DONOVAN, J. ' END || 'Under RSA ' || CAST(o_orderkey % 700 AS STRING) || ':' || CAST(o_orderkey % 9 + 1 AS STRING) || ', II and RSA chapter 91-A we find that. ' "
    "|| CASE o_orderkey % 3 WHEN 0 THEN 'Affirmed.' WHEN 1 THEN 'Reversed and remanded.' ELSE 'So ordered.' END",
}
_FROM = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"

_JUSTICE = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(K.ROSTER))
VOTES = {
    "case_number": "l_orderkey",
    "justice_key": f"CASE l_suppkey % 9 {_JUSTICE} END",
    "vote": "CASE WHEN l_returnflag = 'R' AND l_linenumber % 4 = 0 THEN 'dissent' WHEN l_linenumber % 4 = 1 THEN 'concur_separate' WHEN l_returnflag = 'A' AND l_linenumber % 4 = 2 THEN 'not_participating' "
    "WHEN l_returnflag = 'N' AND l_linenumber % 4 = 3 THEN 'recused' ELSE 'majority' END",
}
TURNS = {
    "case_number": "conv_id",
    "turn": "turn",
    "speaker": "CASE role WHEN 'assistant' THEN 'Justice' ELSE 'Counsel' END",
    "text": "text",
}


def _columns(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in exprs.items())


CASES_SQL = f"cases AS (SELECT {_columns(CASES)} FROM {_FROM})"
VOTES_SQL = f"""votes AS (
  SELECT case_number, justice_key, vote FROM (
    SELECT {_columns(VOTES)}, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 9 ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS r FROM lineitem
  ) WHERE r = 1)"""
TURNS_SQL = f"turns AS (SELECT {_columns(TURNS)} FROM conversations)"
ROSTER_SQL = "roster AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {i}, '{k.replace('_', ' ').upper()}')" for i, k in enumerate(K.ROSTER)) + ") AS r(justice_key, seat, last_name))"
APPOINTED_SQL = "appointed AS (SELECT justice_key, CASE WHEN seat = 8 THEN NULL ELSE make_date(CAST(1994 + seat AS INT), 6, 1) END AS date_appointed FROM roster)"


class Tables:
    """The derived tables over one directory of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def folder(self, name: str) -> str:
        """A new folder that driver and executors share; one of our own only in local mode and where none is set."""
        root = self.spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not self.spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        return f"{root.rstrip('/')}/casemill-{name}-{uuid.uuid4().hex}"

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def cases(self) -> DataFrame:
        o, c, n, r = (self.raw(x) for x in ("orders", "customer", "nation", "region"))
        joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
        return joined.selectExpr(*(f"{e} AS {k}" for k, e in CASES.items()))

    @cached_property
    def votes(self) -> DataFrame:
        from ..operators.build import first_per_key

        rows = self.raw("lineitem").selectExpr(*(f"{e} AS {k}" for k, e in VOTES.items()), "struct(l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS at", "struct(l_orderkey, l_suppkey % 9 AS j) AS k")
        return first_per_key(rows, "k", "at").select("case_number", "justice_key", "vote")

    @cached_property
    def turns(self) -> DataFrame:
        return self.raw("conversations").selectExpr(*(f"{e} AS {k}" for k, e in TURNS.items()))

    @cached_property
    def roster(self) -> DataFrame:
        from ..operators.votes import roster_table

        return roster_table(self.spark.range(1))

    @cached_property
    def appointed(self) -> DataFrame:
        return self.roster.selectExpr("justice_key", "CASE WHEN seat = 8 THEN NULL ELSE make_date(1994 + seat, 6, 1) END AS date_appointed")

    @cached_property
    def case_items(self) -> DataFrame:
        """Orders with the sets of brands and types of their parts."""
        from pyspark.sql import functions as F

        lines, parts = self.raw("lineitem").select("l_orderkey", "l_partkey"), self.raw("part").select("p_partkey", "p_brand", "p_type")
        rows = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).groupBy(F.col("l_orderkey").alias("case_number"))
        return rows.agg(F.collect_set("p_brand").alias("topics"), F.collect_set("p_type").alias("rsa_citations"))
