"""Citations between cases: edge list, most-cited ranking, graph rank and shortest paths.

Edges are a stored table of (citing, cited), so its joins are on keys only.  A case that a large share
of all others cites is a hot key: it is resolved by ``spread_join`` and ranked by sums with a map-side part.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import Stored, spread_join

#: Volumes are only bounded by what a bigint holds: a case whose volume were not read would lose its edges.
REPORTER = "\\b(\\d{1,18})\\s+N\\.\\s?H\\.\\s+(\\d{1,5})\\b"


def normal_citation(c: Column, pattern: str = REPORTER, reporter: str = "N.H.") -> Column:
    """``volume reporter page`` of the first citation in a text; null if there is none."""
    volume = F.regexp_extract(c, pattern, 1)
    plain = F.concat_ws(" ", volume.cast("bigint").cast("string"), F.lit(reporter), F.regexp_extract(c, pattern, 2).cast("int").cast("string"))
    return F.when(F.coalesce(volume, F.lit("")) != "", plain)


def citations_in(text: Column, pattern: str = REPORTER, reporter: str = "N.H.") -> Column:
    """Every reporter citation of a text in normal form, repeated ones too."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0)
    return F.transform(found, lambda x: normal_citation(x, pattern, reporter))


def citation_edges(
    cases: DataFrame, store: Stored, key: str = "case_number", citation: str = "citation", text: str = "text", hot_rows: int = 100_000,
    pattern: str = REPORTER, reporter: str = "N.H.",
) -> DataFrame:
    """Stored rows ``citing, citation, cited, mentions``: one per case and case cited in its text.

    ``cited`` is null where no case has the citation (the edge is kept); of several with the same
    citation the smallest key is cited.  A case's own citation is no edge.
    """
    own = normal_citation(F.col(citation), pattern, reporter)
    listed = cases.select(F.col(key).alias("citing"), own.alias("_own"), F.explode(citations_in(F.col(text), pattern, reporter)).alias("citation"))
    mentions = listed.where(~F.col("citation").eqNullSafe(F.col("_own"))).groupBy("citing", "citation").agg(F.count(F.lit(1)).alias("mentions"))
    stored = store.table(mentions, "mentions")
    lookup = cases.select(own.alias("citation"), F.col(key).alias("cited")).where("citation is not null").groupBy("citation").agg(F.min("cited").alias("cited"))
    edges = store.table(spread_join(stored, lookup, "citation", hot_rows).select("citing", "citation", "cited", "mentions"), "edges")
    store.drop(stored)
    return edges


def most_cited(edges: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` cases with most citing cases, then most mentions: partial sums, then a top-k."""
    counted = edges.where("cited is not null").groupBy("cited").agg(F.count(F.lit(1)).alias("cited_by"), F.sum("mentions").alias("mentions"))
    return counted.orderBy(F.desc("cited_by"), F.desc("mentions"), "cited").limit(k)


def _sum(c: Column, few: int = 1000) -> Column:
    """Sum of doubles.  One running sum of very many loses digits, more or fewer by the order of rows, so beyond ``few`` their
    parts of whole 2**-20 are summed as integers, and what is left apart."""
    whole = F.floor(c * 2.0**20)
    return F.when(F.count(c) > few, F.sum(whole) / 2.0**20 + F.sum(c - whole / 2.0**20)).otherwise(F.sum(c))


def citation_rank(cases: DataFrame, edges: DataFrame, store: Stored, key: str = "case_number", damping: float = 0.85, tolerance: float = 1e-6, most_rounds: int = 50) -> DataFrame:
    """Rank of every case: ``1 - damping`` plus ``damping`` times what its citing cases give it, each of which deals
    its own rank evenly over the cases it cites.

    Rounds end when the ranks move by less than ``tolerance`` a case on average, or after ``most_rounds``.
    A round is one join by citing case, one sum by cited case (partial on the map side) and one stored table
    that carries each case's rank with the list of what it cites.
    """
    cites = edges.where("cited is not null").groupBy("citing").agg(F.collect_set("cited").alias("_cites"))
    nodes = cases.select(F.col(key).alias("node")).distinct()
    base = float(1 - Decimal(str(damping)))  # 0.15 and not 0.15000000000000002
    state = store.table(nodes.join(cites, F.col("node") == F.col("citing"), "left").select("node", "_cites", F.lit(1.0).alias("rank"), F.lit(1.0).alias("_moved")), "rank")
    for _ in range(most_rounds):
        given = state.where("_cites is not null").select(F.explode("_cites").alias("_to"), (F.col("rank") / F.size("_cites")).alias("_given"))
        given = given.groupBy("_to").agg(_sum(F.col("_given")).alias("_given"))
        now = base + damping * F.coalesce(F.col("_given"), F.lit(0.0))
        after = state.join(given, F.col("node") == F.col("_to"), "left").select("node", "_cites", now.alias("rank"), F.abs(now - F.col("rank")).alias("_moved"))
        after = store.table(after, "rank")
        store.drop(state)
        state = after
        moved = state.agg(F.avg("_moved")).first()[0]
        if moved is None or moved < tolerance:
            break
    return state.select(F.col("node").alias(key), "rank")


def citation_path(edges: DataFrame, store: Stored, start, goal, most_steps: int = 100) -> DataFrame:
    """``step, node`` of a shortest chain of citations from ``start`` to ``goal``; no rows if there is none.

    Breadth first: each round joins the cases reached last with the edges and leaves out those reached
    before.  Of several citing cases the smallest is gone back to.  Only the chain itself comes to the driver.
    """
    spark = edges.sparkSession
    links = edges.where("cited is not null").select("citing", "cited")
    kind = dict(links.dtypes)["cited"]
    reached = store.table(spark.range(1).select(F.lit(start).cast(kind).alias("node"), F.lit(None).cast(kind).alias("back"), F.lit(0).alias("step")), "reached")
    levels = [reached]
    found = start == goal
    while not found and len(levels) <= most_steps:
        front = levels[-1].select(F.col("node").alias("citing"))
        new = links.join(front, "citing").groupBy("cited").agg(F.min("citing").alias("back"))
        before = reduce(DataFrame.unionAll, (level.select("node") for level in levels))
        new = new.join(before, F.col("cited") == F.col("node"), "left_anti")
        level = store.table(new.select(F.col("cited").alias("node"), "back", F.lit(len(levels)).alias("step")), "reached")
        levels.append(level)
        found = bool(level.where(F.col("node") == F.lit(goal)).limit(1).count())
        if not found and not level.limit(1).count():
            break
    chain, at = [], goal
    for step in range(len(levels) - 1, -1, -1) if found else ():
        chain.append((step, at))
        at = levels[step].where(F.col("node") == F.lit(at)).first()["back"]
    return spark.createDataFrame(chain, f"step int, node {kind}")


def ranked(ranks: DataFrame, k: int, key: str = "case_number") -> DataFrame:
    """The ``k`` cases of highest rank."""
    return ranks.orderBy(F.desc("rank"), key).limit(k)


def citing_by_group(edges: DataFrame, groups: DataFrame, store: Stored, key: str = "case_number", group: str = "topic", hot_rows: int = 100_000) -> DataFrame:
    """Citations between groups (topics, courts, years) of citing and cited cases."""
    of = lambda name: groups.groupBy(F.col(key).alias(name)).agg(F.min(group).alias(f"{name}_{group}"))
    named = store.table(edges.where("cited is not null").join(of("citing"), "citing"), "citing-groups")
    return spread_join(named, of("cited"), "cited", hot_rows).groupBy(f"citing_{group}", f"cited_{group}").agg(F.count(F.lit(1)).alias("n"))


def first_citations(edges: DataFrame, dates: DataFrame, key: str = "case_number", date: str = "date_issued") -> DataFrame:
    """Per cited case the first and last day on which it was cited."""
    by_day = edges.where("cited is not null").join(dates.select(F.col(key).alias("citing"), date), "citing")
    return by_day.groupBy("cited").agg(F.min(date).alias("first_cited"), F.max(date).alias("last_cited"), F.count(F.lit(1)).alias("cited_by"))
