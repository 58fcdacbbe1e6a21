"""Votes: extraction from decision text, summaries, records and agreement between justices.

The working form is one row per (case, justice).  The pair join is on the case, so it grows
with the square of the panel only (at most nine), never of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from ..functions import clean as N
from ..functions import constants as K
from .reports import count_if, share, since_appointment
from .stored import bounded_broadcast


def roster_table(df: DataFrame) -> DataFrame:
    """The fixed roster: key, display name, role, last name and seat."""
    rows = F.array(
        *(
            F.struct(
                F.lit(k).alias("justice_key"), F.lit(K.DISPLAY[k]).alias("display_name"),
                F.lit("chief_justice" if "C.J." in K.DISPLAY[k] else "associate_justice").alias("role"),
                F.lit(k.replace("_", " ").upper()).alias("last_name"), F.lit(i).alias("seat"),
            )
            for i, k in enumerate(K.ROSTER)
        )
    )
    return df.sparkSession.range(1).select(F.inline(rows))


def active_justices(justices: DataFrame, active: bool = True, flag: str = "is_active") -> DataFrame:
    return justices.where(F.coalesce(F.col(flag), F.lit(False)) == active)


def roster_order(justices: DataFrame, role: str = "role", name: str = "last_name") -> DataFrame:
    """The chief justice first, then by last name."""
    return justices.orderBy(F.coalesce(F.col(role), F.lit("")) != "chief_justice", name)


def explode_votes(df: DataFrame, key: str = "case_number", votes: str = "votes") -> DataFrame:
    """The nested map as one row per justice."""
    return df.select(key, F.explode(votes).alias("justice_key", "_v")).select(key, "justice_key", "_v.*")


def vote_in(votes: str, justice: str) -> Column:
    """A justice's vote in a nested map; not participating where there is none."""
    return F.coalesce(F.try_element_at(F.col(votes), F.lit(justice))["vote"], F.lit("not_participating"))


def vote_summary(votes: DataFrame, key: str = "case_number", vote: str = "vote") -> DataFrame:
    """Counts per case, the vote string and the three flags; whoever was absent is not participating."""
    v = F.coalesce(F.col(vote), F.lit("not_participating"))
    out = votes.groupBy(key).agg(*(count_if(v == p, p) for p in K.PARTICIPATING), count_if(~v.isin(*K.PARTICIPATING), "not_participating"))
    took_part = F.col("majority") + F.col("dissent") + F.col("concur_separate")
    return out.withColumns({
        "vote_string": F.when(took_part > 0, F.concat_ws("-", "majority", "dissent")).otherwise("N/A"),
        "is_unanimous": (F.col("dissent") == 0) & (took_part > 0),
        "has_dissent": F.col("dissent") > 0,
        "has_separate_concurrence": F.col("concur_separate") > 0,
    })


def vote_record(cases: DataFrame, votes: DataFrame, justice: str, key: str = "case_number") -> DataFrame:
    """Every case with the justice's vote; not participating where there is none."""
    own = votes.where(F.col("justice_key") == justice).select(key, "vote")
    return cases.select(key).join(own, key, "left").select(key, F.lit(justice).alias("justice_key"), F.coalesce("vote", F.lit("not_participating")).alias("vote"))


def roster_votes(cases: DataFrame, votes: DataFrame, roster: DataFrame, key: str = "case_number") -> DataFrame:
    """One row per case and roster justice, with a default vote.  The roster has a handful of rows."""
    full = cases.select(key).distinct().crossJoin(bounded_broadcast(roster.select("justice_key")))
    return full.join(votes.select(key, "justice_key", "vote"), [key, "justice_key"], "left").withColumn("vote", F.coalesce("vote", F.lit("not_participating")))


def with_year(cases: DataFrame, first: int | None = None, last: int | None = None, term: str = "term_year", citation: str | None = None) -> DataFrame:
    """Cases whose effective year (term, else citation) is known and in the range, as ``effective_year``."""
    year = N.effective_year(F.col(term), F.col(citation) if citation else F.lit(None).cast("int"))
    out = cases.withColumn("effective_year", year).where("effective_year is not null")
    out = out.where(F.col("effective_year") >= first) if first is not None else out
    return out.where(F.col("effective_year") <= last) if last is not None else out


def votes_in_years(votes: DataFrame, cases: DataFrame, first: int | None = None, last: int | None = None, key: str = "case_number", **years) -> DataFrame:
    """Votes of the cases that ``with_year`` keeps."""
    return votes.join(with_year(cases, first, last, **years).select(key), key, "left_semi")


def justice_profile(
    cases: DataFrame, votes: DataFrame, justices: DataFrame, first: int | None = None, last: int | None = None, key: str = "case_number", citation: str | None = None
) -> DataFrame:
    """Cases since the appointment in which a justice took part, dissented or wrote, with shares in per cent.

    Votes count by the effective year of their case; opinions written by the term year, and for an
    appointed justice only with a date.
    """
    j = bounded_broadcast(justices.select("justice_key", "date_appointed"))
    in_range = with_year(cases, first, last, citation=citation)
    heard = votes.join(in_range.select(key, "date_issued", "effective_year", "author"), key).join(j, "justice_key")
    heard = heard.where(since_appointment(F.col("date_issued"), F.col("effective_year"), F.col("date_appointed")))
    took_part = F.col("vote").isin(*K.PARTICIPATING)
    out = heard.groupBy("justice_key").agg(
        count_if(took_part, "participated"), count_if(F.col("vote") == "dissent", "dissents"), count_if(F.col("author") == F.col("justice_key"), "authored_on_panel"),
    )
    wrote = with_year(cases, first, last).select(F.col("author").alias("justice_key"), "date_issued").join(j, "justice_key")
    wrote = wrote.where(F.col("date_appointed").isNull() | (F.col("date_issued") >= F.col("date_appointed"))).groupBy("justice_key").agg(F.count(F.lit(1)).alias("authored"))
    out = justices.select("justice_key").join(out, "justice_key", "left").join(wrote, "justice_key", "left").na.fill(0)
    return out.withColumns({
        "authorship_pct": F.round(100 * share(F.col("authored"), F.col("participated"), 6), 2),
        "dissent_pct": F.round(100 * share(F.col("dissents"), F.col("participated"), 6), 2),
    })


def vote_distribution(votes: DataFrame, justice: str) -> DataFrame:
    return votes.where((F.col("justice_key") == justice) & F.col("vote").isNotNull()).groupBy("vote").agg(F.count(F.lit(1)).alias("n"))


def agreement_pairs(votes: DataFrame, key: str = "case_number", absent: tuple[str, ...] = K.ABSENT) -> DataFrame:
    """Shared and agreeing cases of each pair ``justice_1 < justice_2``, and their share."""
    took = votes.where(F.col("vote").isNotNull() & ~F.col("vote").isin(*absent)).select(key, "justice_key", "vote")
    a, b = took.select(key, F.col("justice_key").alias("justice_1"), F.col("vote").alias("v1")), took.select(key, F.col("justice_key").alias("justice_2"), F.col("vote").alias("v2"))
    pairs = a.join(b, key).where("justice_1 < justice_2").groupBy("justice_1", "justice_2").agg(F.count(F.lit(1)).alias("shared"), count_if(F.col("v1") == F.col("v2"), "agreed"))
    return pairs.withColumn("agreement", share(F.col("agreed"), F.col("shared")))


def agreement_matrix(votes: DataFrame, roster: DataFrame, key: str = "case_number") -> DataFrame:
    """Every ordered pair of the roster: 1 on the diagonal, 0 without a shared case."""
    found = agreement_pairs(votes, key)
    both = found.select("justice_1", "justice_2", "agreement").union(found.select("justice_2", "justice_1", "agreement"))
    r = roster.select("justice_key")
    every = r.select(F.col("justice_key").alias("justice_1")).crossJoin(bounded_broadcast(r.select(F.col("justice_key").alias("justice_2"))))  # the roster squared
    same = F.col("justice_1") == F.col("justice_2")
    return every.join(both, ["justice_1", "justice_2"], "left").select("justice_1", "justice_2", F.when(same, 1.0).otherwise(F.coalesce("agreement", F.lit(0.0))).alias("agreement"))


def per_curiam_share(cases: DataFrame, year: str = "term_year", author: str = "author") -> DataFrame:
    """Share of unsigned opinions per year, for years that have one."""
    out = cases.where(F.col(year).isNotNull()).groupBy(year).agg(count_if(F.col(author) == "per_curiam", "per_curiam"), F.count(F.lit(1)).alias("total"))
    return out.where("per_curiam > 0").withColumn("share", share(F.col("per_curiam"), F.col("total")))


def bench_seats(votes: DataFrame, seats: int = 5, order: tuple[str, ...] = K.BENCH_ORDER, key: str = "case_number") -> DataFrame:
    """The first five of a case's justices in the order of the bench; if none has a seat, the first five by key."""
    sat = votes.groupBy(key).agg(F.sort_array(F.collect_set("justice_key")).alias("_sat"))  # a panel
    seated = F.array_intersect(F.array(*map(F.lit, order)), F.col("_sat"))
    shown = F.slice(F.when(F.size(seated) > 0, seated).otherwise(F.col("_sat")), 1, seats)
    return sat.select(key, F.posexplode(shown).alias("place", "justice_key")).select(key, "justice_key", (F.col("place") + 1).alias("place"))


#: What a clause says, first match first.
CLAUSES = (
    ("\\b(?:did not participate|not participat|recused|disqualified)\\b", "not_participating"),
    ("\\bconcurred\\s+specially\\b", "concur_separate"),
    ("\\bdissented\\b", "dissent"),
    ("\\bconcurred\\b", "majority"),
)


def clause_vote(clause: Column) -> Column:
    out = F
    for pattern, vote in CLAUSES:
        out = out.when(clause.rlike(f"(?i){pattern}"), vote)
    return out


def extract_votes(docs: DataFrame, roster: DataFrame, key: str = "case_number", text: str = "text", author: str | None = "author", word_boundary: bool = False) -> DataFrame:
    """Votes named in decision texts: one row per case and roster justice with vote and note.

    Segments are all lines and then all pairs of neighbouring lines, parted at semicolons.  The
    first clause that names a justice (by last name, anywhere in it) decides; a later absence
    replaces the note of an absence.  The author is in the majority unless mentioned otherwise.
    ``word_boundary`` keeps a name such as "Will" from matching inside other words.  All clauses of a
    case are in its own row, so nothing is shuffled.
    """
    told = lambda clauses: F.filter(
        F.transform(clauses, lambda c: F.struct(clause_vote(c).alias("vote"), F.upper(c).alias("upper"), F.trim(c, F.lit(" \t\r\n")).alias("note"))),
        lambda x: x["vote"].isNotNull(),
    )
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    rows = docs.select(key, *([author] if author else []), lines.alias("_lines"))
    pairs = F.zip_with("_lines", F.slice("_lines", F.lit(2), F.size("_lines")), lambda x, y: F.concat(x, F.lit(" "), y))
    segments = F.concat("_lines", F.filter(pairs, lambda x: x.isNotNull()))
    rows = rows.withColumn("_told", told(F.flatten(F.transform(segments, lambda s: F.split(s, ";")))))
    names = roster.agg(F.collect_list(F.struct("justice_key", "display_name", "role", "last_name")).alias("_roster"))  # one row
    absent = "not_participating"

    def vote_of(j: Column) -> Column:
        named = (lambda x: F.rlike(x["upper"], F.concat(F.lit("\\b"), j["last_name"], F.lit("\\b")))) if word_boundary else (lambda x: x["upper"].contains(j["last_name"]))
        return F.struct(j["justice_key"].alias("justice_key"), j["display_name"].alias("display_name"), j["role"].alias("role"), F.filter("_told", named).alias("hits"))

    out = rows.join(F.broadcast(names)).select(key, *([author] if author else []), F.inline(F.transform("_roster", vote_of)))
    first, last_absent = F.get("hits", F.lit(0)), F.try_element_at(F.filter("hits", lambda x: x["vote"] == absent), F.lit(-1))
    wrote = (F.col(author) == F.col("justice_key")) & (F.col(author) != "per_curiam") if author else F.lit(False)
    vote = F.coalesce(first["vote"], F.when(wrote, "majority").otherwise(absent))
    note = F.when(first["vote"] == absent, last_absent["note"]).otherwise(first["note"])
    return out.select(key, "justice_key", "display_name", "role", vote.alias("vote"), note.alias("note"))
