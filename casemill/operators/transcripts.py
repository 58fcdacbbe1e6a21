"""Oral-argument transcripts: statistics, quality scores, turns and links to cases.

The thresholds of the quality score are the loosest round values that agree with published
scores, not known constants, and are parameters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import clean as N
from .reports import count_if

CASE = "case_number"


def words_in(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "\\s+"), lambda x: x != ""))


def occurrences(c: Column, mark: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))


def per(count: Column, base: Column, digits: int = 4) -> Column:
    return F.round(F.coalesce(count / F.nullif(base, F.lit(0)), F.lit(0.0)), digits)


def transcript_stats(
    segments: DataFrame, case: str = CASE, text: str = "text", seconds: Column | None = None, speaker: str | None = "speaker",
    question: str = "?", exclamation: str = "!", long_words: int = 100, very_long_words: int = 200, same: Column | None = None,
) -> DataFrame:
    """Counts, rates and duplicates of each case's segments.

    ``seconds`` is an aggregate that gives the duration; ``same`` is what makes two segments
    equal (their text by default).
    """
    rows = segments.withColumns({"_w": words_in(F.col(text)), "_c": F.length(F.coalesce(F.col(text), F.lit(""))), "_same": F.col(text) if same is None else same})
    by_text = rows.groupBy(case, "_same").agg(F.count(F.lit(1)).alias("_k")).groupBy(case).agg(F.sum(F.col("_k") - 1).alias("duplicate_segment_instances"))
    aggs = [
        F.count(F.lit(1)).alias("segment_count"), F.sum("_w").alias("word_count"), F.sum("_c").alias("character_count"),
        F.round(F.avg("_w"), 4).alias("avg_words_per_segment"), F.round(F.percentile("_w", F.lit(0.5)), 4).alias("median_words_per_segment"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY _w)").cast("long").alias("p90_words_per_segment"), F.max("_w").cast("long").alias("max_segment_words"),
        F.round(F.avg("_c"), 4).alias("avg_chars_per_segment"), F.round(F.percentile("_c", F.lit(0.5)), 4).alias("median_chars_per_segment"),
        count_if(F.col("_w") >= long_words, "long_segment_count"), count_if(F.col("_w") >= very_long_words, "very_long_segment_count"),
        count_if(F.col(text).contains(question), "question_segment_count"), F.sum(occurrences(F.col(text), question)).cast("long").alias("question_mark_count"),
        F.sum(occurrences(F.col(text), exclamation)).cast("long").alias("exclamation_mark_count"),
    ]
    if seconds is not None:
        aggs.append(seconds.cast("double").alias("duration_seconds"))
    if speaker:
        aggs += [count_if(F.col(speaker) == "Justice", "justice_segments"), count_if(F.col(speaker) == "Counsel", "counsel_segments")]
    out = rows.groupBy(case).agg(*aggs).join(by_text, case)
    out = out.withColumns({
        "long_segment_ratio": per(F.col("long_segment_count"), F.col("segment_count")),
        "repeated_segment_ratio": per(F.col("duplicate_segment_instances"), F.col("segment_count")),
    })
    if seconds is not None:
        minutes = F.col("duration_seconds") / 60
        out = out.withColumns({
            "words_per_minute": per(F.col("word_count"), minutes), "segments_per_minute": per(F.col("segment_count"), minutes),
            "questions_per_minute": per(F.col("question_mark_count"), minutes),
        })
    if speaker:
        out = out.withColumns({
            "justice_guess_ratio": per(F.col("justice_segments"), F.col("segment_count")), "counsel_guess_ratio": per(F.col("counsel_segments"), F.col("segment_count")),
        })
    return out


def repeated_windows(segments: DataFrame, window: int = 8, case: str = CASE, segment: str = "segment", text: str = "text") -> DataFrame:
    """Windows of ``window`` words that occurred before in the same case, and their density.

    Windows are taken inside segments, so a row explodes to its own windows only.
    """
    w = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "\\s+"), lambda x: x != "")
    rows = segments.select(case, w.alias("w"))
    grams = F.expr(f"CASE WHEN size(w) >= {window} THEN transform(sequence(1, size(w) - {window - 1}), i -> array_join(slice(w, i, {window}), ' ')) ELSE cast(array() AS array<string>) END")
    windows = rows.select(case, F.explode(grams).alias("g")).groupBy(case, "g").agg(F.count(F.lit(1)).alias("k"))
    again = windows.groupBy(case).agg(F.sum(F.col("k") - 1).alias("repeated_window_count"))
    total = rows.groupBy(case).agg(F.sum(F.size("w")).alias("word_count"))
    out = total.join(again, case, "left").na.fill(0, ["repeated_window_count"])
    return out.withColumn("repeated_window_density", per(F.col("repeated_window_count"), F.col("word_count"), 6))


def opening_position(segments: DataFrame, phrases: Sequence[str], case: str = CASE, segment: str = "segment", text: str = "text", start: str | None = None) -> DataFrame:
    """Index (and time) of the first segment with an opening phrase; null if there is none."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hit = F.lit(False)
    for p in phrases:
        hit = hit | low.contains(p.lower())
    aggs = [F.min(F.when(hit, F.col(segment))).alias("opening_counsel_index")]
    if start:
        aggs.append(F.min_by(start, F.when(hit, F.col(segment))).alias("opening_counsel_start_seconds"))
    return segments.groupBy(case).agg(*aggs)


def quality_score(stats: DataFrame, late: int = 8, repeated_high: float = 0.03, repeated: float = 0.015, density: float = 0.01, rerun_from: int = 60) -> DataFrame:
    """Score, priority, recommendation, warnings and rerun flag from opening index and repetition."""
    i, ratio, dense = F.col("opening_counsel_index"), F.col("repeated_segment_ratio"), F.coalesce(F.col("repeated_window_density"), F.lit(0.0))
    opening = F.when(i.isNull(), 25).when(i >= late, 10).otherwise(0)
    loops = F.when(ratio >= repeated_high, 12).when((ratio >= repeated) | (dense >= density), 6).otherwise(0)
    s = F.col("operational_quality_score")
    out = stats.withColumn("operational_quality_score", (F.lit(100) - opening - loops).cast("int"))
    out = out.withColumn("review_priority", F.when(s < 70, "high").when(s <= 90, "medium").otherwise("low"))
    return out.withColumns({
        "recommendation": F.when(F.col("review_priority") == "high", "review-and-consider-turbo-rerun").when(F.col("review_priority") == "medium", "review-opening").otherwise("accept-default"),
        "warnings": F.array_compact(F.array(
            F.when(i.isNull(), "opening-not-found").when(i >= late, "opening-late"), F.when(loops == 12, "repeated-segments-high").when(loops == 6, "repeated-segments"),
        )),
        "rerun_turbo_recommended": i.isNull() | (i >= rerun_from),
    })


def review_list(scored: DataFrame, below: int = 100, case: str = CASE) -> DataFrame:
    """Lowest scores first."""
    return scored.where(F.col("operational_quality_score") < below).orderBy("operational_quality_score", case)


def stage_rollup(status: DataFrame, stages: Sequence[str] = ("discovery", "download", "transcription", "diarization", "public_render")) -> DataFrame:
    """Cases per stage and status, from one struct column per stage."""
    pairs = F.array(*(F.struct(F.lit(s).alias("stage"), F.coalesce(F.col(f"{s}.status"), F.lit("pending")).alias("status")) for s in stages))
    return status.select(F.inline(pairs)).groupBy("stage", "status").agg(F.count(F.lit(1)).alias("n"))


def stats_index(stats: DataFrame) -> DataFrame:
    """Nested statistics as one flat row per case."""
    flat = [c for c in stats.columns if c != "metrics"]
    return stats.select(*flat, "metrics.*")


def merge_turns(turns: DataFrame, case: str = CASE, turn: str = "turn", speaker: str = "speaker", text: str = "text") -> DataFrame:
    """Consecutive turns of one speaker as one paragraph.  The windows run inside a case."""
    order = W.partitionBy(case).orderBy(turn)
    fresh = F.coalesce(F.col(speaker) != F.lag(speaker).over(order), F.lit(True)).cast("int")
    rows = turns.withColumn("_new", fresh).withColumn("paragraph", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = rows.groupBy(case, "paragraph").agg(F.min(speaker).alias("speaker"), F.count(F.lit(1)).alias("turns"), F.sort_array(F.collect_list(F.struct(turn, text))).alias("_t"))
    return out.withColumn("text", F.array_join(F.transform("_t", lambda x: x[text]), " ")).drop("_t")


def transcript_link(transcripts: DataFrame, opinions: DataFrame, case: str = CASE) -> DataFrame:
    """Transcripts and opinions by docket, combined dockets taken apart; never by name or year.

    A docket that was argued twice has a row for each transcript.
    Flags a differing argument date, and a name whose edit distance is over a third of its length.
    """
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")
    t = transcripts.select(F.explode(N.docket_list(F.col(case))).alias(case), F.col("argument_date"), F.col("case_name").alias("t_name"), F.lit(True).alias("_t"))
    o = opinions.select(case, "date_argued", F.col("case_name").alias("o_name"), F.lit(True).alias("_o"))
    out = t.join(o, case, "full")
    a, b = plain(F.col("t_name")), plain(F.col("o_name"))
    both = F.col("_t").isNotNull() & F.col("_o").isNotNull()
    return out.select(
        case, F.when(both, "both").when(F.col("_t").isNotNull(), "transcript-only").otherwise("opinion-only").alias("link_state"),
        F.when(both, ~F.col("argument_date").eqNullSafe(F.col("date_argued"))).alias("date_mismatch"),
        F.when(both, 3 * F.levenshtein(a, b) > F.greatest(F.length(a), F.length(b))).alias("name_mismatch"),
    )
