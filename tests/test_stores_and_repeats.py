"""Stored upserts, file listings and repeated runs: by hand and against brute force."""

import os
import random

import numpy as np

from casemill.operators import build, repeats
from casemill.operators.stored import Stored
from casemill.sources import tables

OVERRIDES = "case_number string, case_name string, override_case_type string, override_reason string"


def test_upsert_rewrites_only_folders_that_change(spark, tmp_path):
    at, store = str(tmp_path / "table"), Stored(spark, str(tmp_path / "steps"))
    frame = lambda rows: spark.createDataFrame(rows, OVERRIDES)
    files = lambda: {f: os.stat(f).st_mtime_ns for d, _, names in os.walk(at) for n in names if n.endswith(".parquet") for f in [f"{d}/{n}"]}
    content = lambda: {r["case_number"]: tuple(r)[1:4] for r in spark.read.schema(OVERRIDES).parquet(at).select("case_number", "case_name", "override_case_type", "override_reason").collect()}
    first = frame([(str(i), f"n{i}", "", None) for i in range(200)] + [(None, "x", "civil", "r"), (" ", "x", "civil", "r")])
    assert build.upsert_stored(first, at, store, buckets=8) == list(range(8))
    assert len(content()) == 200 and content()["7"] == ("n7", "", "")
    before = files()
    assert build.upsert_stored(first, at, store, buckets=8) == [] and files() == before
    rewritten = build.upsert_stored(frame([("7", "other", "civil", "auto"), ("8", "n8", "", "")]), at, store, buckets=8)
    assert len(rewritten) == 1
    changed = {f for f in set(before) ^ set(files())}
    assert changed and all(f"bucket={rewritten[0]}/" in f for f in changed)
    assert content()["7"] == ("n7", "civil", "auto") and len(content()) == 200
    assert build.upsert_stored(frame([("7", "again", "criminal", "late")]), at, store, buckets=8) == []  # what is filled in stays
    assert len(build.upsert_stored(frame([("new", "n", "civil", "r")]), at, store, buckets=8)) == 1 and len(content()) == 201


def test_listing_finds_missing_files(spark, tmp_path):
    for name in ("2020/a 1.pdf", "2020/b+2.pdf", "2021/deep/er/c.pdf", "2021/d.txt"):
        f = tmp_path / "tree" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x" * len(name))
    listed = tables.list_files(spark, str(tmp_path / "tree"), "*.pdf")
    assert {(r["local_path"], r["bytes"]) for r in listed.collect()} == {("2020/a 1.pdf", 12), ("2020/b+2.pdf", 12), ("2021/deep/er/c.pdf", 18)}
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString().lower().replace("contentlength", "")
    expected = spark.createDataFrame([("1", "2020/a 1.pdf"), ("2", "2020/zz.pdf"), ("3", "2021/d.txt"), ("4", None)], "case_number string, local_path string")
    assert sorted(r["case_number"] for r in build.missing_files(expected, listed).collect()) == ["2", "3", "4"]


def brute(codes):
    best = (0, 0, 0)
    for a in range(len(codes)):
        for b in range(a + 1, len(codes)):
            n = 0
            while b + n < len(codes) and codes[a + n] == codes[b + n]:
                n += 1
            if n > best[0]:
                best = (n, a, b)
    return best


def test_longest_repeat_against_all_pairs():
    rng = random.Random(5)
    for _ in range(400):
        codes = [rng.randrange(rng.choice([1, 2, 5, 40])) for _ in range(rng.randint(0, 40))]
        length, a, b, n = repeats.longest_repeat(np.array(codes, dtype=np.int64))
        assert (length, a, b) == brute(codes), codes
        assert n == (sum(codes[i : i + length] == codes[a : a + length] for i in range(len(codes) - length + 1)) if length else 0)


def test_repeated_runs_stay_inside_segments(spark):
    rows = [(1, 0, "a b c d"), (1, 1, "x A B c"), (1, 2, None), (2, 0, ""), (3, 0, "q q q"), (4, 0, "a b"), (4, 1, "c a"), (4, 2, "b c"), (5, 0, " ".join(f"w{i % 4999}" for i in range(60_000)))]
    got = repeats.repeated_runs(spark.createDataFrame(rows, "case_number int, segment int, text string").repartition(3))
    want = {(1, 8, 3, 0, 5, 2, "a b c"), (2, 0, 0, None, None, 0, None), (3, 3, 2, 0, 1, 2, "q q"), (4, 6, 1, 0, 3, 2, "a")}
    rest = {tuple(r) for r in got.collect() if r["case_number"] < 5}
    assert rest == want
    assert got.where("case_number = 5").first()["length"] == 60_000 - 4999
