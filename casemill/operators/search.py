"""Weighted description search."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import constants as K
from .stored import Stored

#: Points of a token in a field, of a token anywhere and of the whole query.
FIELD_POINTS = {"case_name": 8, "summary_paragraph": 4, "topics": 5, "rsa_citations": 6}
ANYWHERE, WHOLE_QUERY = 1, 12


def tokens(query: str) -> list[str]:
    """Words of three characters or more that are no stopwords; repeated ones count again."""
    return [t for t in re.findall(r"[a-z0-9][a-z0-9:-]{2,}", query.lower()) if t not in K.STOPWORDS]


def score(fields: Mapping[str, Column], points: Mapping[str, int], query: Column, words: Sequence[Column]) -> Column:
    """Points of one query: substring tests on the lower-cased fields, all inside one projection."""
    low = {k: F.lower(F.coalesce(c, F.lit(""))) for k, c in fields.items()}
    blob = F.concat_ws(" ", *low.values())
    total = F.when(blob.contains(query), WHOLE_QUERY).otherwise(0)
    for w in words:
        for k, p in points.items():
            total = total + F.when(low[k].contains(w), p).otherwise(0)
        total = total + F.when(blob.contains(w), ANYWHERE).otherwise(0)
    return total


def description_search(
    df: DataFrame, query: str, k: int = 10, fields: Sequence[str] = ("case_name", "summary_paragraph", "topics", "rsa_citations", "lower_court", "case_type", "appeal_type", "outcome", "author_display"),
    points: Mapping[str, int] = FIELD_POINTS, key: str = "case_number", date: str = "date_issued",
) -> DataFrame:
    """The ``k`` best rows by score, then newest, then key: one scan and a top-k."""
    words = tokens(query)
    if not words:
        return df.withColumn("score", F.lit(0)).where(F.lit(False))
    types = dict(df.dtypes)
    text = {f: F.array_join(f, " ") if types[f].startswith("array") else F.col(f).cast("string") for f in fields}
    # a score needs one token somewhere, so most rows are dropped before any points are counted
    any_token = "(?i)" + "|".join(re.escape(w) for w in dict.fromkeys(words))
    df = df.where(F.concat_ws(" ", *text.values()).rlike(any_token))
    scored = df.withColumn("score", score(text, points, F.lit(query.strip().lower()), [F.lit(w) for w in words]))
    return scored.where("score > 0").orderBy(F.desc("score"), F.desc_nulls_last(date), key).limit(k)


def many_searches(df: DataFrame, queries: Mapping[str, str], k: int = 10, key: str = "case_number", date: str = "date_issued", **options) -> DataFrame:
    """The ``k`` best rows of each of a given set of queries, as one plan."""
    out = None
    for name, q in queries.items():
        part = description_search(df, q, k, key=key, date=date, **options).withColumn("query", F.lit(name))
        out = part if out is None else out.unionByName(part)
    rank = W.partitionBy("query").orderBy(F.desc("score"), F.desc_nulls_last(date), key)
    return out.withColumn("rank", F.row_number().over(rank))


# A table of queries -------------------------------------------------------------------------

DESCRIBED = ("case_name", "summary_paragraph", "topics", "rsa_citations", "lower_court", "case_type", "appeal_type", "outcome", "author_display")


def _grams(word: Column, n: int = 3) -> Column:
    """Distinct runs of ``n`` characters; the word must have as many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substring(word, i, F.lit(n))))


def _query_tokens(queries: DataFrame, query_id: str, query: str) -> DataFrame:
    """``query_id, token, times``: the tokens of each query without stopwords; repeated ones count again."""
    found = F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit("[a-z0-9][a-z0-9:-]{2,}"), 0)
    rows = queries.select(F.col(query_id).alias("query_id"), F.explode(found).alias("token"))
    return rows.where(~F.col("token").isin(*K.STOPWORDS)).groupBy("query_id", "token").agg(F.count(F.lit(1)).cast("int").alias("times"))


def token_words(tokens_: DataFrame, words: DataFrame) -> DataFrame:
    """``token, word`` for each word that has the token inside: joined by the token's rarest trigram, then compared."""
    grams = words.select("word", F.explode(_grams(F.col("word"))).alias("gram"))
    held = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    asked = tokens_.select("token", F.explode(_grams(F.col("token"))).alias("gram")).join(held, "gram")
    # a token with a trigram that no word has is in none
    need = tokens_.select("token", F.size(_grams(F.col("token"))).alias("need"))
    asked = asked.groupBy("token").agg(F.min(F.struct("n", "gram")).alias("best"), F.count(F.lit(1)).alias("got")).join(need, "token").where("got = need")
    return asked.select("token", F.col("best.gram").alias("gram")).join(grams, "gram").where(F.col("word").contains(F.col("token"))).select("token", "word")


def table_search(
    rows: DataFrame, queries: DataFrame, store: Stored, k: int = 10, fields: Sequence[str] = DESCRIBED, points: Mapping[str, int] = FIELD_POINTS,
    key: str = "case_number", date: str = "date_issued", query_id: str = "query_id", query: str = "query", common_rows: int = 2000,
) -> DataFrame:
    """``query_id, rank, key, score``: what ``description_search`` gives, for each row of a table of queries.

    A token lies inside one run of its characters, so an index from the distinct runs of the fields (words) to
    their rows finds it: token to words by trigram, word to rows by postings.  Tokens of at most ``common_rows``
    rows give candidates of their own.  A row without any of these gets the points of the query's common
    tokens only; so the first ``k`` rows by the common tokens, found once for all queries that have the same, are
    the only further candidates.  (A query without rare tokens may also match as a whole: rows with all its tokens
    are candidates.)  Candidates are then scored by their texts.  The result is exact; ``common_rows`` only moves work.
    """
    types = dict(rows.dtypes)
    texts = {f: F.lower(F.coalesce(F.array_join(f, " ") if types[f].startswith("array") else F.col(f).cast("string"), F.lit(""))) for f in fields}
    plain = store.table(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(date).alias("date"), *(c.alias(f"f{i}") for i, c in enumerate(texts.values()))), "search-rows")
    words_of = F.array(*(F.struct(F.lit(1 << i).alias("field"), F.array_distinct(F.regexp_extract_all(f"f{i}", F.lit("[a-z0-9:-]{3,}"), 0)).alias("words")) for i in range(len(texts))))
    postings = plain.select("key", F.explode(words_of).alias("w")).select("key", "w.field", F.explode("w.words").alias("word"))
    postings = store.table(postings.groupBy("key", "word").agg(F.bit_or("field").alias("mask")), "postings")
    asked = store.table(_query_tokens(queries, query_id, query), "query-tokens")
    words = postings.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    found = store.table(token_words(asked.select("token").distinct(), words.where(F.length("word") >= 3)).join(words, "word"), "token-words")
    sizes = found.groupBy("token").agg(F.sum("df").alias("df"))
    asked = store.table(asked.join(sizes, "token"), "query-tokens")  # tokens of no row give no points
    rare, common = asked.where(F.col("df") <= common_rows), asked.where(F.col("df") > common_rows)

    rare_words = found.join(rare.select("token").distinct(), "token").select("token", "word")
    rare_rows = rare_words.join(postings.select("word", "key"), "word").select("token", "key").distinct()
    candidates = rare.select("query_id", "token").join(rare_rows, "token").select("query_id", "key").distinct()

    # common tokens: which queries have the same, and the first k rows of each such set
    sets = common.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("token", "times"))).alias("set"))
    sets = store.table(sets, "token-sets")
    distinct_sets = sets.select("set").distinct().withColumn("set_id", F.xxhash64("set"))
    members = distinct_sets.select("set_id", F.inline("set"))
    common_words = found.join(common.select("token").distinct(), "token").select("token", "word")
    # a common word's rows are read where they lie: the few common tokens are sent to the postings
    by_word = common_words.groupBy("word").agg(F.collect_list("token").alias("tokens"))
    by_word = F.broadcast(by_word) if by_word.limit(100_001).count() <= 100_000 else by_word
    hits = postings.join(by_word, "word").select("key", F.explode("tokens").alias("token"), "mask").groupBy("key", "token").agg(F.bit_or("mask").alias("mask"))
    worth = sum((F.when(F.col("mask").bitwiseAND(1 << i) != 0, points.get(f, 0)).otherwise(0) for i, f in enumerate(fields)), F.lit(ANYWHERE))
    hits = store.table(hits.select("key", "token", worth.alias("worth")), "common-hits")
    members = F.broadcast(members) if members.limit(100_001).count() <= 100_000 else members
    by_set = hits.join(members, "token").groupBy("set_id", "key").agg(F.sum(F.col("times") * F.col("worth")).alias("score"), F.count(F.lit(1)).alias("n"))
    dated = by_set.join(plain.select("key", "date"), "key")
    first = W.partitionBy("set_id").orderBy(F.desc("score"), F.desc_nulls_last("date"), "key")
    heads = dated.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).select("set_id", "key")
    named = sets.withColumn("set_id", F.xxhash64("set"))
    candidates = candidates.unionByName(named.join(heads, "set_id").select("query_id", "key"))
    only_common = named.join(rare.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "set_id", F.size("set").alias("n"))
    candidates = candidates.unionByName(only_common.join(by_set, ["set_id", "n"]).select("query_id", "key")).distinct()

    listed = asked.groupBy("query_id").agg(F.collect_list(F.struct("token", "times")).alias("tokens"))
    wholes = queries.select(F.col(query_id).alias("query_id"), F.lower(F.trim(query)).alias("whole"))
    full = store.table(candidates, "candidates").join(listed, "query_id").join(wholes, "query_id").join(plain, "key")
    blob = F.concat_ws(" ", *(f"f{i}" for i in range(len(texts))))

    def of_token(t: Column) -> Column:
        got = F.when(F.col("blob").contains(t["token"]), ANYWHERE).otherwise(0)
        for i, f in enumerate(fields):
            if points.get(f):
                got = got + F.when(F.col(f"f{i}").contains(t["token"]), points[f]).otherwise(0)
        return got * t["times"]

    total = F.aggregate("tokens", F.lit(0), lambda s, t: s + of_token(t)) + F.when(F.col("blob").contains(F.col("whole")), WHOLE_QUERY).otherwise(0)
    scored = full.withColumn("blob", blob).select("query_id", "key", "date", total.alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("date"), "key")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query_id").alias(query_id), "rank", F.col("key").alias(key), "score")
