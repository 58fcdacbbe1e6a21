"""Operators on small hand-made tables, and invariants."""

import datetime as dt

from pyspark.sql import functions as F

from casemill.operators import build, reports, search, text, transcripts, votes
from casemill.sources import tables
from casemill.streaming.incremental import incremental_stream

OPINION = "AFFIRMED.\nBASSETT and HICKS, JJ., concurred; GOULD, J., dissented.\nBy the court.\nLYNN, C.J., did not\nparticipate; he will be away."


def test_vote_extraction(spark):
    docs = spark.createDataFrame([(1, OPINION, "donovan"), (2, None, "per_curiam")], "case_number int, text string, author string")
    roster = votes.roster_table(docs)
    got = {(r["case_number"], r["justice_key"]): r for r in votes.extract_votes(docs, roster).collect()}
    assert len(got) == 18
    vote = lambda k: got[1, k]["vote"]
    assert (vote("bassett"), vote("gould"), vote("donovan"), vote("lynn")) == ("majority", "dissent", "majority", "not_participating")
    assert got[1, "lynn"]["note"].startswith("LYNN")
    assert all(got[2, k]["vote"] == "not_participating" for k in ("bassett", "gould"))


def test_word_boundary_keeps_the_verb_apart(spark):
    docs = spark.createDataFrame([(1, "The clerk will note that all concurred.", "lynn")], "case_number int, text string, author string")
    roster = votes.roster_table(docs)
    vote = lambda **k: {r["justice_key"]: r["vote"] for r in votes.extract_votes(docs, roster, **k).collect()}["will"]
    assert vote() == "majority"
    docs = spark.createDataFrame([(1, "WILLIAM concurred.", "lynn")], "case_number int, text string, author string")
    assert vote(word_boundary=True) == "not_participating"


def some_votes(spark):
    rows = [(c, k, ("majority", "dissent", "recused")[(c * 7 + i) % 3]) for c in range(12) for i, k in enumerate(("lynn", "gould", "will"))]
    return spark.createDataFrame(rows, "case_number int, justice_key string, vote string")


def test_agreement_matrix_is_symmetric_with_unit_diagonal(spark):
    v = some_votes(spark)
    m = {(r[0], r[1]): r[2] for r in votes.agreement_matrix(v, votes.roster_table(v)).collect()}
    assert len(m) == 81
    assert all(m[k, k] == 1.0 for k, _ in m)
    assert all(m[a, b] == m[b, a] for a, b in m)
    assert m["hicks", "lynn"] == 0.0


def test_vote_summary(spark):
    v = spark.createDataFrame([(1, "a", "majority"), (1, "b", "recused"), (2, "a", None)], "case_number int, justice_key string, vote string")
    got = {r["case_number"]: r for r in votes.vote_summary(v).collect()}
    assert (got[1]["vote_string"], got[1]["is_unanimous"], got[1]["not_participating"]) == ("1-0", True, 1)
    assert (got[2]["vote_string"], got[2]["is_unanimous"]) == ("N/A", False)


def test_override_upsert_converges_in_one_pass(spark):
    ddl = "case_number string, case_name string, override_case_type string, override_reason string"
    old = spark.createDataFrame([("1", "A", "civil", ""), ("2", "B", " ", None)], ddl)
    new = spark.createDataFrame([("2", "B", "criminal", "rule"), ("3", "C", "civil", "rule")], ddl)
    once = build.override_upsert(old, new)
    rows = sorted(map(tuple, once.collect()))
    assert rows == [("1", "A", "civil", ""), ("2", "B", "criminal", "rule"), ("3", "C", "civil", "rule")]
    assert sorted(map(tuple, build.override_upsert(once, new).collect())) == rows


def test_union_keeps_nulls_and_drops_placeholders(spark):
    a = spark.createDataFrame([("1", None), (None, "Request a Transcript")], "case_number string, case_name string")
    b = spark.createDataFrame([("2", "x", 5)], "case_number string, case_name string, extra int")
    assert sorted(r["case_number"] for r in build.union_orders(a, b).collect()) == ["1", "2"]


def test_normalize_cases_reports_how_a_type_was_found(spark):
    df = tables.empty_cases(spark)
    rows = spark.createDataFrame([("1", "State v. X", "case_order", None, None), ("2", "A v. B", "case_order", None, ["criminal"]), ("3", "A v. B", "opinion", "civil", None)], "case_number string, case_name string, opinion_type string, case_type string, topics array<string>")
    out = build.normalize_cases(df.unionByName(rows, allowMissingColumns=True)).orderBy("case_number").collect()
    assert [(r["case_type"], r["inference_confidence"], r["inference_reason"], r["case_type_was_null"]) for r in out] == [
        ("criminal", "high", "state_v_case_name", True), ("criminal", "high", "topic_based", False), ("civil", None, None, None),
    ]


def test_on_this_day_goes_around_the_turn_of_the_year(spark):
    df = spark.createDataFrame([(1, dt.date(2020, 12, 30)), (2, dt.date(2019, 1, 9)), (3, dt.date(2018, 12, 30)), (4, None)], "case_number int, date_issued date")
    assert [r["case_number"] for r in reports.on_this_day(df, dt.date(2021, 1, 2)).collect()] == [1, 3]
    assert [r["case_number"] for r in reports.on_this_day(df, dt.date(2021, 1, 9)).collect()] == [2]


def test_pivot_total_is_the_sum_of_its_columns(spark):
    df = spark.createDataFrame([("x", "affirmed"), ("x", "odd_one"), ("y", "vacated"), (None, "vacated")], "court string, outcome string")
    got = {r["court"]: r["total"] for r in reports.outcome_pivot(df, "court").collect()}
    assert got == {"x": 1, "y": 1}
    rates = {r["judge"]: r for r in reports.judge_rates(df.withColumnRenamed("court", "judge"), least=1).collect()}
    assert (rates["x"]["total"], rates["x"]["affirm_pct"]) == (2, 50.0)


def test_search_ranks_and_needs_tokens(spark):
    df = spark.createDataFrame([(1, "Custody of A", None), (2, "A v. B", "custody matters"), (3, "x", "y")], "case_number int, case_name string, summary_paragraph string").withColumn("date_issued", F.lit(None).cast("date"))
    run = lambda q: [(r["case_number"], r["score"]) for r in search.description_search(df, q, fields=("case_name", "summary_paragraph")
        , points={"case_name": 8, "summary_paragraph": 4}).collect()]
    assert run("custody") == [(1, 21), (2, 17)]
    assert run("of the") == []


def test_turns_and_quality(spark):
    t = spark.createDataFrame([(1, 0, "A", "x"), (1, 1, "A", "y"), (1, 2, "B", "z"), (1, 3, "A", "w")], "case_number int, turn int, speaker string, text string")
    got = [tuple(r) for r in transcripts.merge_turns(t).orderBy("paragraph").select("speaker", "text").collect()]
    assert got == [("A", "x y"), ("B", "z"), ("A", "w")]
    s = spark.createDataFrame([(None, 0.05, 0.0), (9, 0.02, 0.0), (0, 0.0, 0.0)], "opening_counsel_index int, repeated_segment_ratio double, repeated_window_density double")
    rows = transcripts.quality_score(s).collect()
    assert [(r["operational_quality_score"], r["review_priority"]) for r in rows] == [(63, "high"), (84, "medium"), (100, "low")]


def test_markdown_turns(spark):
    md = spark.createDataFrame([("2024-0001", "# Title\n\n**Justice A**: hello\nthere\n\n**Counsel**: yes")], "case_number string, text string")
    assert [tuple(r) for r in tables.turns_of(md).select("speaker", "text").collect()] == [("Justice A", "hello\nthere"), ("Counsel", "yes")]


def test_sources_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", ["RSA 1", "RSA 2"], 2020)], "case_number string, rsa_citations array<string>, term_year int")
    cases = tables.empty_cases(spark).unionByName(rows, allowMissingColumns=True)
    tables.write_flat_csv(cases, str(tmp_path / "csv"))
    back = tables.read_cases_csv(spark, str(tmp_path / "csv")).first()
    assert (back["rsa_citations"], back["topics"], back["term_year"]) == (["RSA 1", "RSA 2"], [], 2020)
    tables.write_cases_json(cases, str(tmp_path / "json"))
    (tmp_path / "panel.json").write_text("[]")
    assert tables.read_panel_orders(spark, str(tmp_path / "panel.json")).count() == 0
    (tmp_path / "topics.json").write_text('{"a": {"label": "A", "description": "d", "keywords": ["k"]}}')
    assert tables.read_taxonomy(spark, str(tmp_path / "topics.json")).first()["keywords"] == ["k"]


def test_text_jobs(spark):
    d = spark.createDataFrame([("See RSA chapter 91-A and RSA 91-A:8, IV. Affirmed.",), (None,)], "text string")
    r = d.select(text.extract_citations(F.col("text")).alias("c"), text.outcome_verb(F.col("text")).alias("o")).collect()
    assert (r[0]["c"], r[0]["o"], r[1]["o"]) == (["RSA 91-A:8, IV"], "affirmed", None)
    assert [x["topics"] for x in text.topic_tags(d, {"a": ["see"], "b": ["zzz"]}).collect()] == [["a"], []]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(40).selectExpr("id AS k", "id * 2 AS v")
    rows.where("k < 10").write.parquet(str(tmp_path / "target"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run adds nothing
        incremental_stream(spark, str(tmp_path / "in"), str(tmp_path / "target"), rows.schema, str(tmp_path / "cp"), "k", files_per_batch=1).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "target")).collect())) == sorted(map(tuple, rows.collect()))


def test_bench_prefers_its_order_and_falls_back_to_keys(spark):
    rows = [(1, k) for k in ("hicks", "bassett", "countway", "gould", "will", "macdonald", "donovan", "hantz_marconi")] + [(2, k) for k in ("zed", "abel")] + [(3, "lynn"), (3, "zed")]
    got = {}
    for r in votes.bench_seats(spark.createDataFrame(rows, "case_number int, justice_key string")).orderBy("place").collect():
        got.setdefault(r["case_number"], []).append(r["justice_key"])
    assert got == {1: ["macdonald", "donovan", "hantz_marconi", "countway", "gould"], 2: ["abel", "zed"], 3: ["lynn"]}


def test_csv_columns_are_read_by_name(spark, tmp_path):
    at = str(tmp_path / "overrides.csv")
    with open(at, "w", encoding="utf-8-sig") as f:
        f.write('case_name,case_number,override_reason,override_case_type\nA v. B,2024-0001,"why, then",civil\nC,,,\n')
    got = [tuple(r) for r in tables.read_overrides(spark, at).collect()]
    assert got == [("2024-0001", "A v. B", "civil", "why, then"), ("", "C", "", "")]
    at = str(tmp_path / "cases.csv")
    with open(at, "w") as f:
        f.write("topics,case_number,term_year,date_issued,unknown\n\"['a', 'b']\",1,2020.0,2020-02-03,x\n,2,,no day,y\n")
    rows = tables.read_cases_csv(spark, at).orderBy("case_number").collect()
    assert (rows[0]["topics"], rows[0]["term_year"], rows[0]["date_issued"], rows[0]["case_name"]) == (["a", "b"], 2020, dt.date(2020, 2, 3), None)
    assert (rows[1]["topics"], rows[1]["term_year"], rows[1]["date_issued"], rows[1]["rsa_citations"]) == ([], None, None, [])


def test_array_files_and_empty_arrays(spark, tmp_path):
    (tmp_path / "a_2020.json").write_text('[\n {"case_number": "1", "outcome": " Remaned"},\n {"case_number": "2"}\n]')
    (tmp_path / "a_2021.json").write_text("[]")
    got = {r["case_number"]: r["outcome"] for r in tables.read_case_json(spark, str(tmp_path / "a_*.json")).collect()}
    assert got == {"1": "remanded", "2": None}


def test_repeats_are_judged_by_whole_texts(spark):
    rows = [(1, i, "Counsel", x) for i, x in enumerate(["Yes?", "Yes? No!", "Yes?", "Ye", None])]
    got = transcripts.transcript_stats(spark.createDataFrame(rows, "case_number int, turn int, speaker string, text string")).first()
    assert (got["duplicate_segment_instances"], got["question_segment_count"], got["question_mark_count"], got["exclamation_mark_count"]) == (1, 3, 3, 1)


def test_orders_are_sorted_by_what_their_text_says(spark):
    rows = [("a", "2/1/2020", "2020"), ("b", "2020-12-01", None), ("c", "soon", "2021.0"), ("d", None, "x"), ("e", None, "2022")]
    got = reports.orders_newest_first(spark.createDataFrame(rows, "case_number string, date_issued string, term_year string")).collect()
    assert [r["case_number"] for r in got] == ["b", "a", "e", "c", "d"]
    assert got[1]["date_issued"] == "2/1/2020"


def test_a_later_absence_replaces_the_note_only(spark):
    text_ = "LYNN, C.J., did not participate.\nGOULD, J., concurred specially; LYNN, C.J., recused.\nGOULD, J., dissented."
    docs = spark.createDataFrame([(1, text_, "donovan"), (1, text_, None), (2, "", "donovan")], "case_number int, text string, author string")
    out = votes.extract_votes(docs, votes.roster_table(docs)).where("case_number = 1 AND justice_key IN ('lynn', 'gould')").distinct().collect()
    got = {r["justice_key"]: (r["vote"], r["note"]) for r in out}
    assert got["gould"][0] == "concur_separate"
    assert got["lynn"][0] == "not_participating" and "recused" in got["lynn"][1]
