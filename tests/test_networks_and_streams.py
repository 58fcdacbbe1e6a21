"""Citation graph, similar texts, searches by table, keyword tables, keyed and event-time streams: by hand or against brute force."""

import datetime as dt
import json
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from casemill.operators import build, citations, search, similar, text, transcripts
from casemill.operators.stored import Stored
from casemill.sources import tables
from casemill.streaming import keyed, volume


@pytest.fixture
def store(spark, tmp_path):
    return Stored(spark, str(tmp_path / "steps"))


# Citations


CASES = [
    (1, "100 N.H. 1", "Own citation 100 N.H. 1 only."),
    (2, "100 N.H. 20", "We follow 100 N.H. 1, 12 (1990), and 100 N. H. 1 again."),
    (3, None, "See 100 N.H. 20; 2031 N.H. 77; 100  N.H. 1"),
    (4, "101 N.H. 5", "100 N.H. 1 and 101 N.H. 5 and 0100 N.H. 020"),
    (5, "101 N.H. 5", "1100 N.H. 12345678 is none, nor is 100 N.H."),
    (6, "102 N.H. 9", "101 N.H. 5 and 102 N.H. 10"),
    (7, "102 N.H. 10", "102 N.H. 9, 100 N.H. 1"),
    (8, "103 N.H. 1", None),
]


@pytest.mark.parametrize("hot", [1, 2, 100])
def test_citation_edges(spark, store, hot):
    cases = spark.createDataFrame(CASES, "case_number long, citation string, text string").repartition(3)
    got = {(r["citing"], r["cited"], r["citation"]): r["mentions"] for r in citations.citation_edges(cases, store, hot_rows=hot).collect()}
    assert got == {
        (2, 1, "100 N.H. 1"): 2, (3, 2, "100 N.H. 20"): 1, (3, None, "2031 N.H. 77"): 1, (3, 1, "100 N.H. 1"): 1, (4, 1, "100 N.H. 1"): 1,
        (4, 2, "100 N.H. 20"): 1, (6, 4, "101 N.H. 5"): 1, (6, 7, "102 N.H. 10"): 1, (7, 6, "102 N.H. 9"): 1, (7, 1, "100 N.H. 1"): 1,
    }


def test_citation_rank_path_and_most_cited(spark, store):
    cases = spark.createDataFrame(CASES, "case_number long, citation string, text string")
    edges = citations.citation_edges(cases, store)
    links = defaultdict(set)
    for r in edges.collect():
        if r["cited"] is not None:
            links[r["citing"]].add(r["cited"])
    rank = {c[0]: 1.0 for c in CASES}
    for _ in range(50):
        new = dict.fromkeys(rank, 0.15)
        for a, to in links.items():
            for b in to:
                new[b] += 0.85 * rank[a] / len(to)
        moved = sum(abs(new[k] - rank[k]) for k in rank) / len(rank)
        rank = new
        if moved < 1e-6:
            break
    got = {r["case_number"]: r["rank"] for r in citations.citation_rank(cases, edges, store).collect()}
    assert got.keys() == rank.keys() and all(math.isclose(got[k], rank[k], rel_tol=1e-9) for k in rank)
    top = citations.most_cited(edges, 2).collect()
    assert [(r["cited"], r["cited_by"], r["mentions"]) for r in top] == [(1, 4, 5), (2, 2, 2)]
    path = lambda a, b: [tuple(r) for r in citations.citation_path(edges, store, a, b).orderBy("step").collect()]
    assert path(6, 1) == [(0, 6), (1, 4), (2, 1)]
    assert path(6, 6) == [(0, 6)] and path(1, 6) == [] and path(8, 1) == []
    assert citations.citation_rank(cases.limit(0), edges.limit(0), store).count() == 0


def test_rank_of_a_case_that_many_cite_keeps_its_digits(spark, store):
    """Sums over 20,000 citing cases against exact ones."""
    n = 20_000
    cites = {i: [j for j in range(1 + i % 3) if j != i] for i in range(1, n)}
    links = spark.createDataFrame([(i, j) for i, js in cites.items() for j in js], "citing long, cited long").repartition(5)
    want, moved = [1.0] * n, 1.0
    while moved >= 1e-6:
        given = defaultdict(list)
        for i, js in cites.items():
            for j in js:
                given[j].append(want[i] / len(js))
        after = [0.15 + 0.85 * math.fsum(given[i]) for i in range(n)]
        want, moved = after, math.fsum(abs(a - b) for a, b in zip(after, want, strict=True)) / n
    got = dict(citations.citation_rank(spark.range(n).withColumnRenamed("id", "case_number"), links, store).collect())
    assert all(abs(got[i] - want[i]) <= 2 * math.ulp(want[i]) for i in range(n))


# Similar texts


def test_similar_rows_against_all_pairs(spark, store):
    rng = random.Random(6)
    common = [f"{a}{b}" for a in "abc" for b in "xyz"]
    texts = [" ".join(rng.choices(common, k=rng.randint(0, 30)) + [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(4))}" for _ in range(rng.randint(0, 12))]) for _ in range(120)]
    texts += [texts[3]] * 7 + [None, "", "12 34", "Zz ZZ zz"]
    rows = list(enumerate(texts))
    terms = {d: Counter(re.findall("[a-z]{2,}", (t or "").lower())) for d, t in rows}
    df = Counter(x for c in terms.values() for x in c)
    vectors = {}
    for d, c in terms.items():
        w = {x: n * (math.log((1 + len(rows)) / (1 + df[x])) + 1) for x, n in c.items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        vectors[d] = {x: v / length for x, v in w.items()}
    want = []
    for q in range(0, len(rows), 5):
        scores = []
        for d, v in vectors.items():
            if d != q and v.keys() & vectors[q].keys():
                scores.append((-round(sum(v[x] * vectors[q][x] for x in v.keys() & vectors[q].keys()), 6), d))
        want += [(q, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:4])]
    frame = spark.createDataFrame(rows, "case_number long, text string").repartition(4)
    for probe, part in ((30, 10), (100_000, 100_000)):  # the first looks at few terms, and common ones in parts
        got = similar.similar_rows(frame, frame.where("case_number % 5 = 0"), store, k=4, probe_rows=probe, part_rows=part)
        assert sorted(tuple(r) for r in got.collect()) == want


class Recorded(Stored):
    """Counts the rows of every stored table."""

    def table(self, df, name):
        out = super().table(df, name)
        self.rows = {**getattr(self, "rows", {}), name: max(getattr(self, "rows", {}).get(name, 0), out.count())}
        return out


def test_similar_rows_store_no_pairs(spark, tmp_path):
    """Every row is near every query, keys are strings, some twice, some null; by blocks, with rare terms joined in parts."""
    rng = random.Random(7)
    common = [f"{a}{b}" for a in "abcd" for b in "wxyz"]
    texts = [(f"d{i:03d}", " ".join(rng.choices(common, k=12) + [f"r{chr(97 + rng.randrange(26))}"])) for i in range(300)]
    texts += [("d007", "aw rr rr"), ("d010", "solo"), (None, "aw bx solo"), (None, "aw aw"), ("none", None)]
    merged = defaultdict(Counter)
    for d, t in texts:
        merged[d].update(re.findall("[a-z]{2,}", t or ""))
    df = Counter(x for c in merged.values() for x in c)
    vectors = {}
    for d, c in merged.items():
        w = {x: n * (math.log((1 + len(texts)) / (1 + df[x])) + 1) for x, n in c.items()}
        vectors[d] = {x: v / math.sqrt(sum(y * y for y in w.values())) for x, v in w.items()}
    asked = [f"d{i:03d}" for i in range(0, 300, 2)]
    want = []
    for q in asked:
        scores = [(-round(sum(v[x] * vectors[q][x] for x in v.keys() & vectors[q].keys()), 6), d) for d, v in vectors.items() if d not in (q, None) and v.keys() & vectors[q].keys()]
        want += [(q, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:5])]
    frame = spark.createDataFrame(texts, "id string, text string").repartition(3)
    queries = frame.where(F.col("id").isin(*asked))
    for sizes in ({}, {"probe_rows": 17, "part_rows": 4, "most_common": 5, "block_postings": 500}):
        store = Recorded(spark, str(tmp_path / f"steps{len(sizes)}"))
        got = similar.similar_rows(frame, queries, store, key="id", **sizes)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
        # the scores of all pairs are 150 times 300 rows
        assert max(store.rows.values()) <= sum(map(len, merged.values()))
    assert similar.similar_rows(frame, queries.where("false"), store, key="id").count() == 0
    assert similar.similar_rows(frame.where("false"), queries, store, key="id").count() == 0


# Searches by table


def test_table_search_equals_single_searches(spark, store):
    rng = random.Random(3)
    names = ["state", "smith", "smithson", "jones", "estate", "in-re", "2020-0123", "custody"]
    rows = []
    for i in range(150):
        words = rng.choices(names, k=3)
        rows.append((i, dt.date(2020, 1, 1 + i % 20) if i % 9 else None, " ".join(words).title(), rng.choice([None, "the smith case", "custody of jones"]), rng.sample(names, 2) if i % 3 else None))
    cases = spark.createDataFrame(rows, "case_number long, date_issued date, case_name string, summary_paragraph string, topics array<string>").repartition(3)
    asked = ["smith", "Smith smith jones", "custody of jones", "the of", "mith", "2020-0123 in-re", "nothing", "state nothing", "", None, "STATE Estate custody", "the smith case"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    points = {"case_name": 8, "summary_paragraph": 4, "topics": 5}
    fields = tuple(points)
    want = []
    for i, q in enumerate(asked):
        found = search.description_search(cases, q or "", 6, fields, points).collect()
        want += [(i, n + 1, r["case_number"], r["score"]) for n, r in enumerate(found)]
    for common in (0, 60, 10_000):
        got = search.table_search(cases, queries, store, 6, fields, points, common_rows=common)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want), common


# Keyword tables


@pytest.mark.parametrize("block", [100, 8_000_000])
def test_tags_from_a_table_as_from_expressions(spark, block):
    taxonomy = {"family": ["child", "custody of", "parent"], "roads": ["car", "road side"], "signs": ["!!", "§ 5"], "none": ["zebra"], "again": ["car"], "upper": ["RSA 5"]}
    texts = ["A CHILD in a car.", "children's scar", "the custody of it!! §  5", "road side, § 5", "Rsa 5 rsa 51", "cart", "car", "_car car_", "écar caré", None, "", "x " * 5000 + "child"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = [(k, i, v) for i, (k, v) in enumerate(taxonomy.items())] + [("blank", 90, ["", None]), ("null", 91, None)]
    table = spark.createDataFrame(rows, "topic string, place int, keywords array<string>")
    for whole in (False, True):
        want = {r["doc_id"]: r["topics"] for r in text.topic_tags(docs, taxonomy, word_boundary=whole).collect()}
        got = {r["doc_id"]: r["topics"] for r in text.topic_tags_by_table(docs, table, word_boundary=whole, block_characters=block).collect()}
        assert got == want, whole
    assert text.topic_tags_by_table(docs, table.limit(0)).where(F.size("topics") > 0).count() == 0


def test_tags_from_a_taxonomy_file(spark, tmp_path):
    many = {f"t{i}": {"label": f"T{i}", "description": "", "keywords": [f"word{i:05d}", f"other {i:05d}"]} for i in range(5000)}
    (tmp_path / "taxonomy.json").write_text(json.dumps(many))
    docs = spark.createDataFrame([(1, "Word00042 and other 00007, word049990"), (2, "word00042word00001 other  00003")], "doc_id int, text string")
    table = tables.read_taxonomy(spark, str(tmp_path / "taxonomy.json"), place=True)
    tags = lambda **o: {r["doc_id"]: r["topics"] for r in text.topic_tags_by_table(docs, table, **o).collect()}
    assert tags() == {1: ["t7", "t42", "t4999"], 2: ["t1", "t42"]}
    assert tags(word_boundary=True) == {1: ["t7", "t42"], 2: []}


# Streams


EVENT = "event_id long, user_id long, kind string"


def events(spark, numbers, user=0):
    return spark.createDataFrame([(i, user, f"k{i % 3}") for i in numbers], EVENT)


def test_keyed_stream_restarts_after_a_failed_batch(spark, tmp_path):
    at = str(tmp_path)
    known = events(spark, range(0, 40, 4))
    for part in (range(0, 20), range(10, 30), range(25, 40)):
        events(spark, part, 1).unionAll(events(spark, part, 2)).coalesce(1).write.mode("append").parquet(f"{at}/in")
    events(spark, [], 1).unionByName(spark.createDataFrame([(None, 1, "k")], EVENT)).coalesce(1).write.mode("append").parquet(f"{at}/in")
    tried = []

    def failing(rows):
        tried.append(1)
        if len(tried) == 2:
            raise RuntimeError("lost")
        return rows

    start = lambda prepare=None, known=known: keyed.keyed_stream(spark, f"{at}/in", f"{at}/out", EVENT, f"{at}/check", known, "event_id", prepare=prepare, files_per_batch=1)
    with pytest.raises(Exception, match="lost"):
        start(failing).awaitTermination()
    start().awaitTermination()
    rows = [tuple(r) for r in keyed.loaded(spark, f"{at}/out", EVENT).select("event_id", "user_id").collect()]
    assert sorted(rows) == [(i, 1) for i in range(40) if i % 4]
    before = len(rows)
    start().awaitTermination()  # nothing new
    events(spark, range(35, 45), 3).coalesce(1).write.mode("append").parquet(f"{at}/in")
    start().awaitTermination()
    after = [r["event_id"] for r in keyed.loaded(spark, f"{at}/out", EVENT).collect()]
    assert len(after) == before + 5 and sorted(after)[-5:] == [40, 41, 42, 43, 44]


def test_keyed_stream_of_many_keys(spark, tmp_path, monkeypatch):
    """Built-in state, no Python call a key; the first record whole, nulls last, one key very often; large numbers stay."""
    monkeypatch.setattr(keyed, "GATHERED", 500)
    at, keys, big = str(tmp_path), 20_000, 2**53
    number = F.when(F.col("id") % 3 == 0, F.lit(None).cast("long")).otherwise(F.col("id") * 2 + big + 1)
    often = F.array(F.struct(F.lit("b").alias("k")))
    rows = spark.range(keys).select(F.col("id").alias("event_id"), number.alias("user_id"), often.alias("parts"))
    rows = rows.unionAll(rows.select("event_id", F.lit(big * 2), "parts")).unionAll(spark.range(9_000).selectExpr("5L", "id + 11", "array(named_struct('k', 'a'))"))
    rows = rows.unionAll(rows.where("event_id = 6").selectExpr("event_id", f"{big * 2}L", "array(named_struct('k', 'a'))"))
    rows.repartition(4).write.parquet(f"{at}/in")
    known = spark.range(0, keys, 4).select(F.col("id").alias("event_id"))
    stream = keyed.keyed_stream(spark, f"{at}/in", f"{at}/out", rows.schema, f"{at}/check", known, "event_id")
    stream.awaitTermination()
    want = {i: (big * 2 if i % 3 == 0 else i * 2 + big + 1, "b") for i in range(keys) if i % 4} | {5: (11, "a"), 6: (big * 2, "a")}
    got = [(r["event_id"], (r["user_id"], r["parts"][0]["k"])) for r in keyed.loaded(spark, f"{at}/out", rows.schema).collect()]
    assert len(got) == len(want) and dict(got) == want
    state = stream.lastProgress["stateOperators"]
    assert [s["operatorName"] for s in state] == ["dedupe"] and state[0]["numRowsTotal"] == keys


def test_volume_keeps_late_rows_within_the_watermark(spark, tmp_path):
    at = str(tmp_path)
    schema = "at timestamp"

    def arrive(*days):
        spark.createDataFrame([(dt.datetime(2024, 1, d, 12),) for d in days], schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        source = spark.readStream.schema(schema).parquet(f"{at}/in")
        volume.volume_stream(source, f"{at}/days", f"{at}/check", "at", lateness="3 days").awaitTermination()

    arrive(1, 2, 2, 5)
    arrive(10, 8)
    arrive(8, 9, 3)  # the watermark is at day 7: 8 and 9 are late but count, 3 comes too late
    arrive(30)
    got = {r["day"].day: r["n"] for r in spark.read.parquet(f"{at}/days").collect()}
    assert got == {1: 1, 2: 2, 5: 1, 8: 2, 9: 1, 10: 1}
    days = spark.read.parquet(f"{at}/days")
    weeks = [(r["period"].isoformat(), r["n"]) for r in volume.volume(days, "week").orderBy("period").collect()]
    assert weeks == [("2024-01-01", 4), ("2024-01-08", 4)]
    gap = days.unionByName(spark.createDataFrame([(dt.date(2024, 4, 2), 5), (None, 9)], "day date, n long"))
    months = [(r["period"].month, r["n"]) for r in volume.volume(gap, "month").orderBy("period").collect()]
    assert months == [(1, 8), (2, 0), (3, 0), (4, 5)]
    assert volume.volume(days.limit(0), "week").count() == 0


# Overrides and transcripts


def test_overrides_change_case_orders_only(spark):
    cases = spark.createDataFrame(
        [("1", "opinion", "civil", "x", "y"), ("2", " Case_Order", "civil", "x", "y"), ("3", "case_order", None, "x", "y"), ("4", "case_order", "civil", "x", "y"), ("5", None, "civil", "x", "y")],
        "case_number string, opinion_type string, case_type string, inference_confidence string, inference_reason string",
    )
    overrides = spark.createDataFrame(
        [("1", "a", "criminal", "r"), (" 2 ", "a", " CRIMINAL ", "r"), ("3", "a", "Family/Domestic", "r"), ("4", "a", "traffic", "r"), ("5", "a", "criminal", ""), (None, "a", "civil", "r"), ("3", "b", "x", "r")],
        "case_number string, case_name string, override_case_type string, override_reason string",
    )
    got = {r["case_number"]: tuple(r)[2:] for r in build.override_apply(cases, overrides).collect()}
    hand = ("manual", "manual_override_table")
    assert got == {"1": ("civil", "x", "y"), "2": ("criminal", *hand), "3": ("family/domestic", *hand), "4": ("civil", "x", "y"), "5": ("civil", "x", "y")}


def test_a_docket_argued_twice_keeps_both_transcripts(spark):
    heard = spark.createDataFrame([("2024-0001", dt.date(2024, 1, 1), "A v. B"), ("2024-0001-2024-0002", dt.date(2024, 5, 1), "A v. B")], "case_number string, argument_date date, case_name string")
    decided = spark.createDataFrame([("2024-0001", dt.date(2024, 5, 1), "A v. B")], "case_number string, date_argued date, case_name string")
    got = sorted((r["case_number"], r["link_state"], r["date_mismatch"]) for r in transcripts.transcript_link(heard, decided).collect())
    assert got == [("2024-0001", "both", False), ("2024-0001", "both", True), ("2024-0002", "transcript-only", None)]


def test_opening_phrase(spark):
    turns = spark.createDataFrame([(1, 0, "Good morning."), (1, 1, "May it please the Court, I am counsel."), (2, 0, "We begin.")], "case_number int, segment int, text string")
    got = {r["case_number"]: r["opening_counsel_index"] for r in transcripts.opening_position(turns, ["may it please the court"], segment="segment").collect()}
    assert got == {1: 1, 2: None}
