"""Similar texts, searches for a table of queries and tags from a keyword table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import search, similar, text
from ..operators.stored import Stored
from .bindings import CASES_SQL, Tables
from .queries import query

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    f"""WITH counted AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[a-z]{{2,}}')) AS term FROM documents) GROUP BY ALL),
    held AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM counted GROUP BY term),
    weighed AS (SELECT doc_id, term, tf * idf AS w FROM counted JOIN held USING (term)),
    v AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM weighed),
    scored AS (SELECT a.doc_id AS query, b.doc_id, round(sum(a.w * b.w), 6) AS score FROM v a JOIN v b ON a.term = b.term AND a.doc_id % 100 = 0 AND a.doc_id <> b.doc_id GROUP BY ALL)
    SELECT query, CAST(row_number() OVER o AS INT) AS rank, doc_id, score FROM scored WINDOW o AS (PARTITION BY query ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 5"""
)
def similar_documents(t: Tables) -> DataFrame:
    """The stated queries are the documents whose id is divisible by 100; they are held against all."""
    docs = t.raw("documents").select("doc_id", "text")
    return similar.similar_rows(docs, docs.where("doc_id % 100 = 0"), Stored(t.spark, t.folder("similar")), key="doc_id")


_FIELDS = {f: "array_join({0}, ' ')" if f in ("topics", "rsa_citations") else "{0}" for f in search.DESCRIBED}
_SOURCE = {"summary_paragraph": "decision", "author_display": "author"}
_LOW = ", ".join(f"lower(coalesce({e.format(_SOURCE.get(f, f)).replace('array_join', 'array_to_string')}, '')) AS {f}" for f, e in _FIELDS.items())
_STOP = ", ".join(f"'{w}'" for w in K.STOPWORDS)
_POINTS = " + ".join(f"CASE WHEN contains({f}, t) THEN {p} ELSE 0 END" for f, p in search.FIELD_POINTS.items())
_ASKED = "s_name || CASE s_suppkey % 4 WHEN 0 THEN ' building' WHEN 1 THEN ' building state v.' ELSE '' END || CASE s_suppkey % 3 WHEN 0 THEN ' superior court' WHEN 1 THEN ' in the matter of' ELSE ' v. state of new hampshire' END"


@query(
    f"""+ q AS (SELECT s_suppkey AS query_id, lower(trim({_ASKED})) AS whole, [t FOR t IN regexp_extract_all(lower({_ASKED}), '[a-z0-9][a-z0-9:-]{{2,}}') IF t NOT IN ({_STOP})] AS tokens FROM supplier),
    f AS (SELECT case_number, date_issued, {_LOW} FROM cases), b AS (SELECT *, concat_ws(' ', {", ".join(_FIELDS)}) AS blob FROM f),
    scored AS (SELECT query_id, case_number, date_issued, CAST(list_sum([{_POINTS} + CASE WHEN contains(blob, t) THEN 1 ELSE 0 END FOR t IN tokens]) + CASE WHEN contains(blob, whole) THEN 12 ELSE 0 END AS INT) AS score FROM q, b)
    SELECT query_id, CAST(row_number() OVER o AS INT) AS rank, case_number, score FROM scored WHERE score > 0 WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, date_issued DESC NULLS LAST, case_number)
    QUALIFY row_number() OVER o <= 10""",
    CASES_SQL,
)
def table_search(t: Tables) -> DataFrame:
    """One search for each supplier, all at once; most of their words are common, some are in no case."""
    rows = t.cases.withColumns({k: F.col(v) for k, v in _SOURCE.items()})
    queries = t.raw("supplier").selectExpr("s_suppkey AS query_id", f"{_ASKED} AS query")
    return search.table_search(rows, queries, Stored(t.spark, t.folder("search")))


_KEYWORDS = f"SELECT item_id, unnest(regexp_extract_all({_LOWERED}, '[a-z]{{4,}}')) AS keyword FROM benchmark"


def _benchmark_words(t: Tables) -> DataFrame:
    """A taxonomy of the benchmark: each item is a topic, its longer words are the keywords."""
    rows = t.raw("benchmark").select("item_id", F.array_distinct(similar.terms(F.col("text"), "[a-z]{4,}")).alias("keywords"))
    return rows.select(F.col("item_id").alias("topic"), F.col("item_id").alias("place"), "keywords")


@query(
    f"""WITH keywords AS (SELECT DISTINCT item_id, keyword FROM ({_KEYWORDS})), low AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
    held AS (SELECT doc_id, keyword FROM low, (SELECT DISTINCT keyword FROM keywords) WHERE contains(t, keyword))
    SELECT doc_id, coalesce(topics, '') AS topics FROM documents LEFT JOIN (SELECT doc_id, string_agg(CAST(item_id AS VARCHAR), ';' ORDER BY item_id) AS topics
      FROM (SELECT DISTINCT doc_id, item_id FROM held JOIN keywords USING (keyword)) GROUP BY doc_id) USING (doc_id)"""
)
def table_tagging(t: Tables) -> DataFrame:
    """Every text against a table of keywords; a keyword may stand inside a word."""
    tagged = text.topic_tags_by_table(t.raw("documents").select("doc_id", "text"), _benchmark_words(t))
    return tagged.select("doc_id", F.array_join("topics", ";").alias("topics"))


@query(
    f"""WITH keywords AS (SELECT DISTINCT item_id, keyword FROM ({_KEYWORDS})), words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+')) AS keyword FROM documents)
    SELECT doc_id, coalesce(topics, '') AS topics FROM documents LEFT JOIN (SELECT doc_id, string_agg(CAST(item_id AS VARCHAR), ';' ORDER BY item_id) AS topics
      FROM (SELECT DISTINCT doc_id, item_id FROM words JOIN keywords USING (keyword)) GROUP BY doc_id) USING (doc_id)"""
)
def table_tagging_whole_words(t: Tables) -> DataFrame:
    """The same with whole words only."""
    tagged = text.topic_tags_by_table(t.raw("documents").select("doc_id", "text"), _benchmark_words(t), word_boundary=True)
    return tagged.select("doc_id", F.array_join("topics", ";").alias("topics"))
