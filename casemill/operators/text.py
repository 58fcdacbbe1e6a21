"""Corpus-wide text jobs: topic tags, statute citations, headers, outcomes and link lists."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions import clean as N
from ..functions import constants as K


def has_keyword(text: Column, keyword: str, word_boundary: bool = False) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.rlike(f"\\b{keyword.lower()}\\b") if word_boundary else low.contains(keyword.lower())


def topic_tags(docs: DataFrame, taxonomy: Mapping[str, Sequence[str]], text: str = "text", word_boundary: bool = False, column: str = "topics") -> DataFrame:
    """``column``: every topic with a keyword in the text, in the order of the taxonomy.

    The keywords become expressions of one projection, so documents are not shuffled.
    """
    tags = []
    for topic, words in taxonomy.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | has_keyword(F.col(text), w, word_boundary)
        tags.append(F.when(hit, F.lit(topic)))
    return docs.withColumn(column, F.array_compact(F.array(*tags)))


#: Characters of keywords and topics that are sent to the tasks at once; a larger table takes several passes over the texts.
BLOCK_CHARACTERS = 8_000_000
_PLACED = pa.list_(pa.struct([("place", pa.int64()), ("topic", pa.string())]))


def _automaton(keywords: list[tuple[str, int, str]]):
    """Finds every keyword (with its places and topics) that ends at a character, in one pass over a text."""
    import ahocorasick

    topics: dict[str, list[tuple[int, str]]] = {}
    for word, place, topic in keywords:
        topics.setdefault(word, []).append((place, topic))
    found = ahocorasick.Automaton()
    for number, (word, placed) in enumerate(topics.items()):
        found.add_word(word, (number, word, placed))
    found.make_automaton()
    return found


def _met(batches: Iterator[pa.RecordBatch], keywords: list[tuple[str, int, str]], text: str, column: str, word_boundary: bool) -> Iterator[pa.RecordBatch]:
    """Add the topics with a keyword in the lower-cased text."""
    automaton = _automaton(keywords) if keywords else None
    letter = re.compile("\\w").match
    for batch in batches:
        lists = []
        for t in batch.column(text).to_pylist():
            low, seen, placed = (t or "").lower(), set(), set()
            for end, (number, word, topics) in automaton.iter(low) if automaton and low else ():
                if number in seen:
                    continue
                if word_boundary:
                    start = end - len(word) + 1
                    before, after = start > 0 and bool(letter(low[start - 1])), end + 1 < len(low) and bool(letter(low[end + 1]))
                    if before == bool(letter(word[0])) or after == bool(letter(word[-1])):
                        continue
                seen.add(number)
                placed.update(topics)
            lists.append([{"place": p, "topic": x} for p, x in sorted(placed)])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, _PLACED)], names=[*batch.schema.names, column])


def topic_tags_by_table(
    docs: DataFrame, taxonomy: DataFrame, text: str = "text", word_boundary: bool = False, column: str = "topics",
    topic: str = "topic", place: str = "place", keywords: str = "keywords", block_characters: int = BLOCK_CHARACTERS,
) -> DataFrame:
    """``topic_tags`` with the taxonomy as a table: ``topic``, its ``place`` in the order, and an array of ``keywords``.

    All keywords are looked for at once, by an automaton over each text, so the cost of a text does not grow with
    their number; documents are not shuffled.  Keywords reach the tasks in blocks of about ``block_characters`` at most
    (their size is summed first); each block is one more pass over the texts.  Keywords are literal, case is ignored, and with
    ``word_boundary`` a keyword counts only where a word boundary stands at both its ends.
    """
    rows = taxonomy.select(F.explode(keywords).alias("keyword"), F.col(place).cast("long").alias("place"), F.col(topic).cast("string").alias("topic"))
    rows = rows.select(F.lower("keyword").alias("keyword"), "place", "topic").where((F.coalesce(F.length("keyword"), F.lit(0)) > 0) & F.col("topic").isNotNull()).distinct()
    total = rows.agg(F.sum(F.length("keyword") + F.length("topic") + 16)).first()[0] or 0
    parts = 1 if total <= block_characters else -(-2 * total // block_characters)
    out, met = docs, []
    for i in range(parts):
        block = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("keyword", "topic"), F.lit(parts)) == i)
        words = sorted((r["keyword"], r["place"] or 0, r["topic"]) for r in block.collect())  # bounded by block_characters
        sent = docs.sparkSession.sparkContext.broadcast(words)
        name = f"_met{i}"
        schema = StructType([*out.schema.fields, StructField(name, ArrayType(StructType([StructField("place", LongType()), StructField("topic", StringType())])))])
        out = out.mapInArrow(lambda batches, sent=sent, name=name: _met(batches, sent.value, text, name, word_boundary), schema)
        met.append(name)
    placed = F.array_sort(F.array_distinct(F.flatten(F.array(*met))))
    return out.withColumn(column, F.transform(placed, lambda x: x["topic"])).drop(*met)


def extract_citations(text: Column) -> Column:
    """Statute citations in a text, cleaned and each once."""
    return N.clean_citations(F.regexp_extract_all(text, F.lit(K.CITATION_IN_TEXT), 1))


def extract_header(text: Column) -> Column:
    """Struct of case number, citation (name, year, number), argued and issued dates and author line."""
    get = lambda p, g=1: F.nullif(F.regexp_extract(text, p, g), F.lit(""))
    cite = K.REPORTER
    day = lambda word: F.try_to_timestamp(get(f"(?i){word}:?\\s+([A-Z][a-z]+ \\d{{1,2}}, \\d{{4}})"), F.lit("MMMM d, yyyy")).cast("date")
    return F.struct(
        get("(?i)(?:Case\\s+)?No\\.\\s*(\\d{4}-\\d{4})").alias("case_number"), get(cite).alias("citation"),
        get(cite, 2).cast("int").alias("citation_year"), get(cite, 3).cast("int").alias("citation_seq"),
        day("Argued").alias("date_argued"), day("(?:Opinion )?Issued").alias("date_issued"),
        F.nullif(F.regexp_replace(get(K.AUTHOR_LINE, 0), "[.\\s]$", ""), F.lit("")).alias("author_line"),
    )


def outcome_verb(text: Column) -> Column:
    """The first disposition of a text as an outcome code."""
    found = F.lower(F.regexp_extract(text, "(?i)\\b(affirmed and remanded|reversed and remanded|affirmed|reversed|remanded|vacated|dismissed)\\b", 1))
    return F.nullif(F.replace(found, F.lit(" "), F.lit("_")), F.lit(""))


def link_text(df: DataFrame, text: str = "text", url: str = "url") -> DataFrame:
    """Links whose text is ``docket, name``, several parted by semicolons: one row per docket."""
    rows = df.select(url, F.explode(F.split(text, ";")).alias("_t"))
    docket = F.regexp_extract("_t", "^\\s*(\\d{4}-\\d{4})", 1)
    name = N.strip(F.regexp_replace("_t", "^\\s*\\d{4}-\\d{4}\\s*,?\\s*", ""))
    out = rows.select(F.col(url).alias("url"), F.nullif(docket, F.lit("")).alias("case_number"), F.nullif(name, F.lit("")).alias("case_name"), F.lit(None).cast("string").alias("citation"))
    return out.where("case_number is not null")


def link_citation(df: DataFrame, name: str = "case_name", url: str = "url") -> DataFrame:
    """Links whose name is ``citation, name``."""
    pattern = "^\\s*(\\d{4}\\s+N\\.H\\.\\s+\\d+)\\s*,\\s*(.*)$"
    part = lambda g: F.nullif(N.strip(F.regexp_extract(name, pattern, g)), F.lit(""))
    return df.select(F.col(url).alias("url"), F.lit(None).cast("string").alias("case_number"), F.coalesce(part(2), N.strip(F.col(name))).alias("case_name"), part(1).alias("citation"))


def link_structured(df: DataFrame) -> DataFrame:
    """Links that come with their fields: ``pdf_url``, ``case_number``, ``case_name`` and ``citation``; blanks are null."""
    part = lambda c: F.nullif(N.strip(F.col(c).cast("string")), F.lit("")).alias(c)
    return df.select(F.col("pdf_url").alias("url"), part("case_number"), part("case_name"), part("citation"))


def keyword_flags(docs: DataFrame, words: Mapping[str, Sequence[str]], column: str, text: str = "text", word_boundary: bool = True) -> DataFrame:
    """``column``: the values of a keyword table (such as standards of review) that a text speaks of, in the table's order."""
    return topic_tags(docs, words, text, word_boundary, column)


def harmonise_links(*parts: DataFrame) -> DataFrame:
    """Union of link lists by name, without placeholders."""
    from .build import without_placeholders

    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return without_placeholders(out)
