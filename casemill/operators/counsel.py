"""Counsel: appearance lines of opinions, spellings of the same name, and win rates per side.

A line such as ``Orr & Reno, P.A., of Concord (Ann B. Smith on the brief, and Lee Jones orally), for the appellant.`` names a
firm, its city, its lawyers and the party; ``A. Smith, pro se.`` a party without a lawyer.  Lines are taken apart inside their
row.  Spellings that differ by one character are brought together by the names with one character left out, which
both have in common: a join on equal strings, not a comparison of all names with all others.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import count_if, share

LINE = "^\\s*([^\\n()]+?)\\s*\\(([^()\\n]*)\\)\\s*,\\s*for\\s+the\\s+([A-Za-z][A-Za-z -]*?)\\s*\\.?\\s*$"
PRO_SE = "^\\s*([^\\n(),]+?)\\s*,\\s*(?:pro se|self-represented(?: party)?)(?:\\s*,\\s*for\\s+the\\s+([A-Za-z][A-Za-z -]*?))?\\s*\\.?\\s*$"
#: What stands beside names in the brackets.
ROLES = "(?i)\\b(?:on the (?:joint )?(?:briefs?|memorand(?:um|a))|orally|(?:senior |deputy |assistant |associate )*attorneys?(?: general)?|solicitor general|of counsel)\\b"
NAME = "^[A-Z][\\w.'’-]*(?: [A-Z][\\w.'’-]*)+$"
#: Which side each party is on; parties named otherwise have none.
SIDES = {"appellant": "appellant", "petitioner": "appellant", "plaintiff-appellant": "appellant", "defendant-appellant": "appellant", "appellee": "appellee", "respondent": "appellee", "State": "appellee"}
#: Outcomes that each side wins; others (and none) count for nobody.
WINS = {"appellant": ("reversed", "remanded", "reversed_and_remanded", "vacated"), "appellee": ("affirmed", "dismissed")}


def _side(party: Column, sides: Mapping[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, side in sides.items():
        out = F.when(F.lower(party) == name.lower(), side).otherwise(out)
    return out


def appearances(cases: DataFrame, key: str = "case_number", text: str = "text", sides: Mapping[str, str] = SIDES) -> DataFrame:
    """``key, line, firm, city, counsel, orally, party, side``: one row per lawyer and line, or one without lawyer
    (``pro_se`` true) per party that appears for itself.  Lines of another form are no appearances."""
    lines = cases.select(F.col(key), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\\n")).alias("line", "_l"))
    part = lambda pattern, g: F.nullif(F.regexp_extract("_l", pattern, g), F.lit(""))
    rows = lines.withColumns({"_who": part(LINE, 1), "_in": part(LINE, 2), "_party": part(LINE, 3), "_self": part(PRO_SE, 1), "_for": part(PRO_SE, 2)})
    rows = rows.where(F.col("_who").isNotNull() | F.col("_self").isNotNull())
    groups = F.split(F.col("_in"), ",")  # names up to a role share it
    spoken = F.transform(groups, lambda g: F.struct(F.split(F.trim(F.regexp_replace(g, ROLES, " ")), "\\s+and\\s+|^and\\s+|\\s+and$").alias("names"), F.lower(g).contains("orally").alias("orally")))
    named = F.flatten(F.transform(spoken, lambda s: F.transform(s["names"], lambda n: F.struct(F.trim(F.regexp_replace(n, "\\s+", " ")).alias("counsel"), s["orally"].alias("orally")))))
    named = F.filter(named, lambda n: n["counsel"].rlike(NAME))
    firm = F.regexp_extract("_who", "^(.*?)(?:,\\s+of\\s+([^,]+))?$", 1)
    city = F.nullif(F.regexp_extract("_who", "^(.*?)(?:,\\s+of\\s+([^,]+))?$", 2), F.lit(""))
    out = rows.select(
        key, "line", F.when(F.col("_who").isNotNull(), firm).alias("firm"), F.when(F.col("_who").isNotNull(), city).alias("city"),
        F.explode_outer(F.when(F.col("_who").isNotNull(), named)).alias("n"), F.coalesce("_party", "_for").alias("party"), F.col("_who").isNull().alias("pro_se"), F.col("_self").alias("_self"),
    )
    return out.select(key, "line", "firm", "city", F.coalesce("n.counsel", "_self").alias("counsel"), F.coalesce("n.orally", F.lit(False)).alias("orally"), "party", _side(F.col("party"), sides).alias("side"), "pro_se")


def plain_name(c: Column) -> Column:
    """Lower case, without punctuation and the forms of a firm or title at the end."""
    low = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[.'’]", ""), "[^\\p{L}\\p{N}&]+", " "))
    return F.trim(F.regexp_replace(low, "(?: (?:pa|pc|pllc|plc|llc|llp|esq|jr|sr|ii|iii|& a))+$", ""))


def same_names(rows: DataFrame, name: str) -> DataFrame:
    """``name, known_as``: every spelling with the most frequent plain spelling at most one character away.

    Frequency counts rows; ties go to the first in the alphabet.  A name is at most one step from what it is known as.
    """
    spelled = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n")).withColumn("_plain", plain_name(F.col(name)))
    counted = spelled.groupBy("_plain").agg(F.sum("n").alias("n"))
    one_less = F.transform(F.sequence(F.lit(1), F.length("_plain")), lambda i: F.concat(F.substring(F.col("_plain"), F.lit(1), i - 1), F.substring(F.col("_plain"), i + 1, F.length("_plain"))))
    variants = F.when(F.length("_plain") > 0, F.array_distinct(F.array_append(one_less, F.col("_plain")))).otherwise(F.array("_plain"))
    shared = counted.select("_plain", "n", F.explode(variants).alias("_v"))
    other = shared.select(F.col("_v"), F.col("_plain").alias("_other"), F.col("n").alias("_n"))
    near = shared.join(other, "_v").where(F.levenshtein("_plain", "_other") <= 1)
    best = near.groupBy("_plain").agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_other").alias("known_as"))).alias("b")).select("_plain", "b.known_as")
    return spelled.join(best, "_plain").select(name, "known_as")


def win_rates(rows: DataFrame, cases: DataFrame, by: str = "firm", key: str = "case_number", outcome: str = "outcome", least: int = 1, wins: Mapping[str, tuple[str, ...]] = WINS) -> DataFrame:
    """``by, side, cases, won, lost, win_rate``: each case once per name and side; cases that nobody wins count in ``cases`` only."""
    once = rows.where(F.col(by).isNotNull() & F.col("side").isNotNull()).select(key, by, "side").distinct()
    other = {side: tuple(o for s, outs in wins.items() if s != side for o in outs) for side in wins}
    code = lambda sets: sum((F.when((F.col("side") == s) & F.col(outcome).isin(*outs), 1).otherwise(0) for s, outs in sets.items()), F.lit(0)) == 1
    joined = once.join(cases.select(key, outcome), key)
    out = joined.groupBy(by, "side").agg(F.count(F.lit(1)).alias("cases"), count_if(code(wins), "won"), count_if(code(other), "lost"))
    return out.where(F.col("cases") >= least).withColumn("win_rate", F.round(F.col("won") / F.nullif(F.col("won") + F.col("lost"), F.lit(0)), 4))


def busiest(rows: DataFrame, k: int = 20, by: str = "counsel", key: str = "case_number") -> DataFrame:
    """The ``k`` names with most cases, and in how many they spoke."""
    cases = rows.where(F.col(by).isNotNull()).groupBy(by, key).agg(F.max("orally").alias("orally"))
    return cases.groupBy(by).agg(F.count(F.lit(1)).alias("cases"), count_if(F.col("orally"), "spoke")).orderBy(F.desc("cases"), by).limit(k)


def self_represented(rows: DataFrame, cases: DataFrame, group: str = "term_year", key: str = "case_number") -> DataFrame:
    """Share of cases in which a party appears for itself, per group."""
    alone = rows.groupBy(key).agg(F.max("pro_se").alias("pro_se"))
    joined = cases.select(key, group).join(alone, key, "left")
    return joined.groupBy(group).agg(F.count(F.lit(1)).alias("cases"), count_if(F.coalesce("pro_se", F.lit(False)), "pro_se")).withColumn("share", share(F.col("pro_se"), F.col("cases")))
