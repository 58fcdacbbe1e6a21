"""Filters, counts, means, cross-tabulations, pivots and ordered reports over case tables.

Every report drops null group keys, as a report has no row for the unknown.  Counts are longs
and means are doubles; ties are broken by a unique column, so results do not depend on the
plan.  All of them are one aggregation with partial sums on the map side, or a top-k.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import clean as N
from ..functions import constants as K

# Filters --------------------------------------------------------------------------------


def in_years(df: DataFrame, first: int, last: int, year: str = "term_year") -> DataFrame:
    return df.where(F.col(year).between(first, last))


def in_values(df: DataFrame, **choices: Sequence) -> DataFrame:
    """Keep rows whose columns are among the chosen values; an empty choice does not filter."""
    for column, values in choices.items():
        if values:
            df = df.where(F.col(column).isin(*values))
    return df


def by_decision(df: DataFrame, kind: str = "all") -> DataFrame:
    column = {"unanimous": "is_unanimous", "dissent": "has_dissent", "separate": "has_separate_concurrence"}.get(kind)
    return df.where(F.col(column)) if column else df


def contains(c: Column, query: str, regex: bool = False) -> Column:
    """Case-insensitive; the query is taken literally unless ``regex``."""
    c = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    return c.rlike(f"(?i){query}") if regex else c.contains(query.lower())


def matching(df: DataFrame, query: str, columns: Sequence[str], regex: bool = False) -> DataFrame:
    """Rows in which any of the columns (arrays are joined) holds the query."""
    types = dict(df.dtypes)
    hit = F.lit(False)
    for c in columns:
        hit = hit | contains(F.array_join(c, " | ") if types[c].startswith("array") else F.col(c), query, regex)
    return df.where(hit) if query else df


def citing(df: DataFrame, query: str, citations: str = "rsa_citations") -> DataFrame:
    """Rows with a citation that holds the query, literally and in any case."""
    return df.where(F.exists(citations, lambda x: F.lower(x).contains(query.lower())))


def with_topics(df: DataFrame, topics: Sequence[str], column: str = "topics") -> DataFrame:
    return df.where(F.arrays_overlap(column, F.array(*map(F.lit, topics)))) if topics else df


def one_case(df: DataFrame, number: str, key: str = "case_number") -> DataFrame:
    return df.where(F.col(key) == number)


def since_appointment(issued: Column, year: Column, appointed: Column) -> Column:
    """Decided on or after the appointment; without a date the year decides, without either it counts."""
    by_year = F.coalesce(year >= F.year(appointed), F.lit(True))
    return F.when(appointed.isNull(), True).when(issued.isNotNull(), issued >= appointed).otherwise(by_year)


# Counts and means -------------------------------------------------------------------------


def counts(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows per key, without null keys."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def means(df: DataFrame, value: str, *keys: str, name: str = "mean", digits: int = 4) -> DataFrame:
    """Mean of the rows that have a number, per key."""
    df = df.where(N.number(F.col(value)).isNotNull())
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(F.round(F.avg(N.number(F.col(value))), digits).alias(name), F.count(F.lit(1)).alias("n"))


def outcome_distribution(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    return counts(df, outcome).withColumn("label", N.outcome_label(F.col(outcome)))


def words_by_case_type(df: DataFrame, kind: str = "case_type", words: str = "word_count") -> DataFrame:
    """Always the three labels, in which a missing one has mean 0 and other labels have no row."""
    labels = df.sparkSession.range(1).select(F.explode(F.array(*(F.lit(x) for x in ("Civil", "Criminal", "Family/Domestic")))).alias("label"))
    found = means(df.withColumn("label", N.case_type_label(F.col(kind))), words, "label", name="mean_words").drop("n")
    return labels.join(found, "label", "left").select("label", F.coalesce("mean_words", F.lit(0.0)).alias("mean_words"))


def by_author(df: DataFrame, author: str = "author") -> DataFrame:
    """Signed opinions only."""
    return df.where(F.col(author).isNotNull() & (F.col(author) != "per_curiam"))


def exploded_counts(df: DataFrame, column: str, k: int | None = None, name: str = "item") -> DataFrame:
    """Rows per list item, most frequent first; ties by item."""
    out = counts(df.select(F.explode(column).alias(name)), name)
    return out.orderBy(F.desc("n"), name).limit(k) if k else out


def citation_chapters(df: DataFrame, k: int = 15, citations: str = "rsa_citations") -> DataFrame:
    """Citations by what stands before the colon."""
    chapters = df.select(F.explode(citations).alias("c")).select(F.trim(F.substring_index("c", ":", 1)).alias("chapter"))
    return counts(chapters, "chapter").orderBy(F.desc("n"), "chapter").limit(k)


def count_if(c: Column, name: str) -> Column:
    return F.count(F.when(c, 1)).alias(name)


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0)), digits)


def term_headline(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"), count_if(F.col("is_unanimous"), "unanimous"), count_if(F.col("has_dissent"), "with_dissent"),
        F.round(F.avg("days_to_decision"), 4).alias("mean_days"),
    )


def court_snapshot(df: DataFrame, year: str = "term_year") -> DataFrame:
    """Totals, the latest term and its cases, unanimous per cent (half to even) and dissents; one pass, folded by year."""
    flag = F.coalesce(F.col("is_unanimous"), F.lit(False)).cast("int")
    per = df.groupBy(F.col(year).alias("_y")).agg(F.count(F.lit(1)).alias("_n"), F.sum(flag).alias("_u"), count_if(F.col("has_dissent"), "_d"))
    return per.agg(
        F.max("_y").alias("latest_term"), F.sum("_n").alias("total"), F.max_by("_n", "_y").alias("in_latest"),
        F.bround(100 * F.sum("_u") / F.sum("_n"), 0).cast("long").alias("unanimous_pct"), F.sum("_d").alias("dissents"),
    )


def flag_share(df: DataFrame, flag: str) -> DataFrame:
    return df.agg(count_if(F.col(flag), "n"), F.count(F.lit(1)).alias("total")).withColumn("share", share(F.col("n"), F.col("total")))


def dataset_stats(df: DataFrame, year: str = "term_year") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))


def facets(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct values of each column, in one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").distinct()


def citation_metrics(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    o = F.col(outcome)
    return df.agg(F.count(F.lit(1)).alias("total"), count_if(o == "affirmed", "affirmed"), count_if(o.contains("revers"), "reversed"))


# Lower courts -----------------------------------------------------------------------------


def court_headline(df: DataFrame, court: str = "lower_court", outcome: str = "outcome") -> DataFrame:
    rows, o = df.where(F.col(court).isNotNull()), F.col(outcome)
    out = rows.agg(
        F.count(F.lit(1)).alias("with_court"), count_if(o == "affirmed", "affirmed"),
        count_if(o.isin("reversed", "reversed_and_remanded"), "reversed"), F.count(o).alias("decided"),
    )
    return out.withColumn("affirmance_rate", share(100 * F.col("affirmed"), F.col("decided")))


def at_least(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows of groups with at least ``n`` rows.  The group sizes are partial sums, so a hot group costs no skew."""
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select(*keys)
    return df.join(big, list(keys), "left_semi")


def outcomes_by(df: DataFrame, key: str, least: int = 1, outcome: str = "outcome") -> DataFrame:
    """Rows per key and outcome label for keys with at least ``least`` decided rows, with the key's total."""
    labelled = df.withColumn("outcome_label", N.outcome_label(F.col(outcome))).where(F.col("outcome_label").isNotNull())
    per = counts(labelled, key, "outcome_label")
    return per.withColumn("total", F.sum("n").over(W.partitionBy(key))).where(F.col("total") >= least)


def outcome_pivot(df: DataFrame, *keys: str, outcome: str = "outcome") -> DataFrame:
    """One column per outcome in fixed order, zero filled, and ``total``, the sum of these columns."""
    labelled = df.withColumn("outcome_label", N.outcome_label(F.col(outcome)))
    for k in keys:
        labelled = labelled.where(F.col(k).isNotNull())
    labelled = labelled.where(F.col("outcome_label").isNotNull())
    wide = labelled.groupBy(*keys).pivot("outcome_label", list(K.OUTCOME_ORDER)).agg(F.count(F.lit(1))).na.fill(0, list(K.OUTCOME_ORDER))
    names = [column_name(x) for x in K.OUTCOME_ORDER]
    wide = wide.toDF(*keys, *names)
    return wide.withColumn("total", sum((F.col(n) for n in names[1:]), F.col(names[0])))


def column_name(label: str) -> str:
    return label.lower().replace(" & ", "_and_")


def judge_rates(df: DataFrame, judge: str = "judge", outcome: str = "outcome", least: int = 3) -> DataFrame:
    """Outcomes of each judge with at least ``least`` decided cases; the total counts every outcome,
    listed or not; rates in per cent, rounded to one place, half to even.  One aggregation."""
    decided = df.where(F.col(judge).isNotNull() & F.col(outcome).isNotNull()).select(judge, N.outcome_label(F.col(outcome)).alias("_label"))
    listed = [count_if(F.col("_label") == x, column_name(x)) for x in K.OUTCOME_ORDER]
    out = decided.groupBy(judge).agg(*listed, F.count(F.lit(1)).alias("total")).where(F.col("total") >= least)
    rate = lambda c: F.bround(100 * c / F.col("total"), 1)
    out = out.withColumn("affirm_pct", rate(F.col("affirmed"))).withColumn("reversal_pct", rate(F.col("reversed") + F.col("reversed_and_remanded")))
    return out.orderBy(F.desc("total"), judge)


# Order and top-k --------------------------------------------------------------------------


def fastest_slowest(df: DataFrame, k: int = 5, days: str = "days_to_decision", key: str = "case_number") -> DataFrame:
    """The ``k`` shortest and longest decision times, each a top-k without a full sort."""
    rows = df.where(F.col(days).isNotNull()).select(key, days)
    fast = rows.orderBy(days, key).limit(k).withColumn("kind", F.lit("fastest"))
    slow = rows.orderBy(F.desc(days), key).limit(k).withColumn("kind", F.lit("slowest"))
    return fast.unionByName(slow)


def newest_first(df: DataFrame, *columns: str, key: str = "case_number") -> DataFrame:
    """By the given columns and the key, all descending with nulls last."""
    return df.orderBy(*(F.desc_nulls_last(c) for c in (*columns, key)))


def orders_newest_first(df: DataFrame, date: str = "date_issued", year: str = "term_year", key: str = "case_number") -> DataFrame:
    """By date, year and number as far as they can be read as such, all descending with nulls last; the columns stay as they are."""
    day = F.coalesce(F.try_to_timestamp(F.col(date).cast("string")), N.us_date(F.col(date).cast("string")).cast("timestamp"))
    return df.orderBy(F.desc_nulls_last(day), F.desc_nulls_last(N.number(F.col(year))), F.desc_nulls_last(F.col(key).cast("string")))


def cases_of_year(df: DataFrame, year: int, column: str = "term_year", name: str = "case_name", key: str = "case_number") -> DataFrame:
    """The cases of one year by name."""
    return df.where(F.col(column) == year).orderBy(F.asc_nulls_last(name), key)


def first_per_group(df: DataFrame, group: str, n: int, *order) -> DataFrame:
    """The first ``n`` rows of each group in an order that must be total."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def on_this_day(df: DataFrame, today: dt.date, date: str = "date_issued") -> DataFrame:
    """Rows issued on this day of any year; if there are none, those of the nearest day of the year
    (around the turn of the year; ties go to the newest).  The day is chosen inside the plan."""
    rows = df.where(F.col(date).isNotNull())
    month, day = today.month, today.day
    apart = F.abs(F.dayofyear(date) - today.timetuple().tm_yday)
    gap = F.when((F.month(date) == month) & (F.dayofmonth(date) == day), -1).otherwise(F.least(apart, 366 - apart))
    best = rows.agg(F.min_by(F.struct(F.month(date).alias("m"), F.dayofmonth(date).alias("d")), F.struct(gap, -F.datediff(F.col(date), F.lit("1970-01-01").cast("date")))).alias("best"))
    picked = rows.crossJoin(F.broadcast(best))  # one row
    return picked.where((F.month(date) == F.col("best.m")) & (F.dayofmonth(date) == F.col("best.d"))).drop("best").orderBy(F.desc(date))
