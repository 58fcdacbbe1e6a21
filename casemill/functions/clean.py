"""Cleaning and derivation of single fields as Column expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column) -> Column:
    """Unicode white space off both ends; ``trim`` takes spaces only."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, "(?U)\\s+", " "))


def blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(strip(c.cast("string")), F.lit("")) == ""


def lookup(c: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)


def title(c: Column) -> Column:
    """Capital after a space, slash or hyphen, as in ``Family/Domestic``."""
    out = F.initcap(c)
    for mark in "/-":
        out = F.array_join(F.transform(F.split(out, mark), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), mark)
    return out


def normalize_outcome(c: Column) -> Column:
    low = F.lower(strip(c))
    return F.coalesce(lookup(low, K.OUTCOME_REPAIR), low)


def clean_summary(c: Column) -> Column:
    """Drop undecodable characters, then one leading and one trailing run of quotes or brackets."""
    out = strip(F.replace(c, F.lit("\ufffd"), F.lit("")))
    out = F.regexp_replace(out, f"(?U)^\\s*{K.QUOTES}\\s*", "")
    return strip(F.regexp_replace(out, f"(?U)\\s*{K.QUOTES}\\s*$", ""))


def clean_citations(c: Column) -> Column:
    """Squeeze, drop a bare chapter word, shorten ``RSA chapter X`` to ``RSA X`` and keep each once, in order; blank ones stay, as one."""
    one = F.transform(c, squeeze)
    one = F.filter(one, lambda x: ~x.rlike("(?i)^RSA\\s+chapters?$"))
    one = F.transform(one, lambda x: F.regexp_replace(x, "(?i)^RSA\\s+chapter\\s+(.+)$", "RSA $1"))
    return F.array_distinct(one)


def primary_citation(citations: Column, previous: Column) -> Column:
    return F.when(F.size(F.coalesce(citations, F.array().cast("array<string>"))) > 0, F.element_at(citations, 1)).otherwise(previous)


def repair_name(c: Column) -> Column:
    """An undecodable character between word characters was an apostrophe."""
    return F.regexp_replace(c, "(?U)(?<=\\w)\ufffd(?=\\w)", "'")


def normalize_court(c: Column) -> Column:
    """Canonical lower-court name, or null if the text names no court.  Each step is computed once."""
    s = F.substring_index(c, "\n", 1)
    s = F.regexp_replace(s, K.CASE_MARKER, "")
    s = F.regexp_replace(s, f"^(.*?{K.JUDGE}).*$", "$1")
    s = F.regexp_replace(s, "(?s)\\([^()]*$", "")  # a last "(" that nothing closes
    s = F.regexp_replace(squeeze(s), "[ ,;-]+$", "")
    s = F.regexp_replace(s, "(?i)^(?:the\\s+|l\\s+in\\s+|in\\s+)", "")

    def named(x: Column) -> Column:
        superior = F.regexp_extract(x, K.SUPERIOR_COURT.format(judge=K.JUDGE), 0)
        superior = F.coalesce(F.nullif(F.regexp_replace(strip(superior), "[ ,;-]+$", ""), F.lit("")), F.lit("Superior Court"))
        low = F.lower(x)
        return (
            F.when(~low.contains("court"), F.lit(None).cast("string"))
            .when(x.rlike(K.FEDERAL_COURT) & ~x.rlike("(?i)superior\\s+court"), "U.S. District Court")
            .when(x.rlike("(?i)superior\\s+court"), superior)
            .otherwise(x)
        )

    return bind(s, named)


def case_type_from_topics(topics: Column, fallback: Column | None = None) -> Column:
    fallback = F.lit(None).cast("string") if fallback is None else fallback
    family = F.array(F.lit("family_law"), F.lit("domestic_violence"))
    return (
        F.when(F.coalesce(F.size(topics), F.lit(0)) <= 0, fallback)
        .when(F.arrays_overlap(topics, family), "family/domestic")
        .when(F.array_contains(topics, "criminal"), "criminal")
        .otherwise("civil")
    )


def statute_markers(citations: Column) -> Column:
    """Chapters such as ``458`` or ``461-a`` named after RSA, each once."""
    found = F.transform(citations, lambda x: F.regexp_extract_all(F.lower(x), F.lit("rsa\\s+([0-9]+(?:-[a-z])?)"), 1))
    return F.array_distinct(F.flatten(found))


def _verdict(value: str | None, confidence: str, reason: str) -> Column:
    return F.struct(F.lit(value).cast("string").alias("case_type"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))


def infer_case_type(name: Column, citations: Column, state: str = "new hampshire") -> Column:
    """Struct (case_type, confidence, reason) by the first signal that holds."""
    name = F.coalesce(strip(name), F.lit(""))
    low, marks = F.lower(name), F.coalesce(statute_markers(citations), F.array().cast("array<string>"))
    family = F.arrays_overlap(marks, F.array(*map(F.lit, K.FAMILY_CHAPTERS)))
    criminal = F.arrays_overlap(marks, F.array(*map(F.lit, K.CRIMINAL_CHAPTERS)))
    return (
        F.when(low.rlike(K.STATE_V.format(state=state.replace(" ", "\\s+"))), _verdict("criminal", "high", "state_v_case_name"))
        .when(low.rlike("|".join(K.FAMILY_WORDS)), _verdict("family/domestic", "high", "family_keyword_case_name"))
        .when(family & ~criminal, _verdict("family/domestic", "medium", "family_rsa_marker"))
        .when(criminal & ~family, _verdict("criminal", "medium", "criminal_rsa_marker"))
        .when(name.rlike(K.INITIALS), _verdict("family/domestic", "low", "initials_case_name_pattern"))
        .otherwise(_verdict(None, "none", "insufficient_signals"))
    )


def default_case_type(name: Column, state: str = "new hampshire") -> Column:
    """Struct (case_type, reason) for a case that nothing else has classified."""
    name = F.coalesce(strip(name), F.lit(""))
    low, place = F.lower(name), state.replace(" ", "\\s+")
    pick = lambda value, reason: F.struct(F.lit(value).alias("case_type"), F.lit(reason).alias("reason"))
    return (
        F.when(low.rlike(K.STATE_V.format(state=place)), pick("criminal", "default_state_v_caption"))
        .when(low.startswith("in the matter of "), pick("family/domestic", "default_in_the_matter_of"))
        .when(name.rlike(K.INITIALS), pick("family/domestic", "default_initials_pattern"))
        .when(low.rlike(f"\\bv\\.\\s+state\\s+of\\s+{place}\\b"), pick("criminal", "default_v_state_caption"))
        .otherwise(pick("civil", "default_fallback_civil"))
    )


def court_base(c: Column) -> Column:
    """Court without its judge and what follows a semicolon."""
    s = strip(F.regexp_replace(c, f"(?U)\\s*{K.JUDGE}\\s*$", ""))
    family = lambda x: F.lower(x).contains("family court") & ~F.lower(x).contains("circuit")
    return bind(squeeze(F.substring_index(s, ";", 1)), lambda x: F.when(family(x), "Family Court").otherwise(x))


def court_judge(c: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(c, K.JUDGE_NAME, 1)), F.lit(""))


def court_type(base: Column) -> Column:
    def kind(low: Column) -> Column:
        circuit, labels = low.contains("circuit"), K.COURT_TYPES
        return (
            F.when(circuit & low.contains("family"), labels["family"])
            .when(circuit & low.contains("district"), labels["district"])
            .when(circuit & low.contains("probate"), labels["probate"])
            .when(circuit, labels["circuit"])
            .when(low.contains("superior"), labels["superior"])
            .when(low.contains("probate"), labels["probate alone"])
        )

    return F.coalesce(bind(F.lower(base), kind), base)


def court_group(kind: Column) -> Column:
    return F.when(kind.startswith("Circuit Court"), "Circuit Court").otherwise(kind)


def outcome_label(c: Column, missing: str | None = None) -> Column:
    label = F.coalesce(lookup(c, K.OUTCOME_LABELS), title(F.replace(c, F.lit("_"), F.lit(" "))))
    return F.when(c.isNull(), F.lit(missing).cast("string")).otherwise(label)


def case_group(kind: Column, topics: Column, citations: Column) -> Column:
    """Declared type, else topics, else the first telling citation, else civil."""
    kind = F.lower(strip(F.coalesce(kind, F.lit(""))))
    topics = F.coalesce(topics, F.array().cast("array<string>"))
    family, criminal = K.FAMILY_CITATION, K.CRIMINAL_CITATION
    telling = F.filter(F.coalesce(citations, F.array().cast("array<string>")), lambda x: x.rlike(family) | x.rlike(criminal))
    first = F.when(F.size(telling) > 0, F.element_at(telling, 1))
    return (
        F.when(kind.isin(*K.FAMILY_TYPES), "family/domestic")
        .when(kind.isin("criminal", "civil"), kind)
        .when(F.arrays_overlap(topics, F.array(F.lit("family_law"), F.lit("domestic_violence"))), "family/domestic")
        .when(F.array_contains(topics, "criminal"), "criminal")
        .when(first.rlike(family), "family/domestic")
        .when(first.rlike(criminal), "criminal")
        .otherwise("civil")
    )


def case_type_label(c: Column) -> Column:
    return F.coalesce(lookup(F.lower(strip(c)), K.CASE_TYPE_LABELS), title(c))


def display_citation(citation: Column, number: Column) -> Column:
    return F.coalesce(F.nullif(strip(citation), F.lit("")), number, F.lit("unknown"))


def title_columns(df):
    """Column names with spaces and capitals."""
    return df.toDF(*(c.replace("_", " ").title() for c in df.columns))


def justice_label(c: Column) -> Column:
    return F.coalesce(lookup(c, K.DISPLAY), title(F.replace(c, F.lit("_"), F.lit(" "))))


def roster_year(c: Column) -> Column:
    return F.when(blank(c), "—").otherwise(F.substring(c.cast("string"), 1, 4))


def intro_excerpt(text: Column) -> Column:
    """What stands between the author line and the first section heading; without one, 3000 characters."""
    parts = F.split(text, K.AUTHOR_LINE, 2)
    body = F.when(F.size(parts) > 1, F.regexp_replace(F.element_at(parts, -1), "(?U)^\\s+", "")).otherwise(text)
    sections = F.split(body, K.SECTION_HEADING, 2)
    intro = F.when(F.size(sections) > 1, strip(F.element_at(sections, 1))).otherwise(strip(F.substring(body, 1, 3000)))
    return F.coalesce(F.substring(F.regexp_replace(intro, "\n{3,}", "\n\n"), 1, 4000), F.lit(""))


def preview(c: Column, n: int = 260) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def mark_citations(text: Column, opening: str = "<mark>", closing: str = "</mark>") -> Column:
    return F.regexp_replace(text, K.CITATION, f"{opening}$1{closing}")


def days_to_decision(issued: Column, argued: Column) -> Column:
    return F.datediff(issued, argued)


def docket_list(c: Column) -> Column:
    """The dockets in a combined number such as ``2024-0722-2024-0723``."""
    return F.regexp_extract_all(c, F.lit("(\\d{4}-\\d{4})"), 1)


def list_column(c: Column) -> Column:
    """Array from its Python or JSON text form, without blanks; empty if malformed."""
    items = F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    return F.filter(items, lambda x: x.isNotNull() & (strip(x) != ""))


def topic_labels(topics: Column) -> Column:
    labels = F.array_join(F.transform(topics, lambda x: title(F.replace(x, F.lit("_"), F.lit(" ")))), " | ")
    return F.coalesce(F.nullif(labels, F.lit("")), F.lit("—"))


def display_date(c: Column) -> Column:
    return F.coalesce(F.date_format(F.try_to_timestamp(c.cast("string")), "MMM dd, yyyy"), F.lit("—"))


def month_day(c: Column) -> Column:
    return F.date_format(c, "MM-dd")


def us_date(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("M/d/yyyy")).cast("date")


def number(c: Column) -> Column:
    """Numeric or null."""
    return c.try_cast("double")


def case_link(number_: Column, prefix: str = "?case=") -> Column:
    return F.concat(F.lit(prefix), F.url_encode(number_))


def effective_year(term: Column, citation: Column) -> Column:
    return F.coalesce(F.nullif(term, F.lit(0)), F.nullif(citation, F.lit(0)))
