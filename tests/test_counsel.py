"""Appearance lines, spellings and win rates by hand; spellings against all pairs."""

import random

from pyspark.sql import functions as F

from casemill.operators import counsel

TEXT = """No. 2020-0001
Orr & Reno, P.A., of Concord (Ann B. Smith and Lee O’Brien on the joint brief, and Kim-Lee Jones orally), for the appellant.
  Jane Roe, attorney general (Sam Poe, senior assistant attorney general, on the brief and orally), for the State.
John Doe, pro se, for the appellee.
Mary Major, self-represented party.
Law Office of X, of New London (on the memorandum), for the amicus curiae.
The brief (such as it was), for the record, is long.
for the plaintiff."""


def lines(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "case_number int, text string")


def test_appearance_lines(spark):
    got = [tuple(r)[1:] for r in counsel.appearances(lines(spark, TEXT, None, "", "x " * 10_000)).collect()]
    firm, ag = ("Orr & Reno, P.A.", "Concord"), ("Jane Roe, attorney general", None)
    assert sorted(got, key=str) == sorted(
        [
            (1, *firm, "Ann B. Smith", False, "appellant", "appellant", False), (1, *firm, "Lee O’Brien", False, "appellant", "appellant", False),
            (1, *firm, "Kim-Lee Jones", True, "appellant", "appellant", False), (2, *ag, "Sam Poe", False, "State", "appellee", False),
            (3, None, None, "John Doe", False, "appellee", "appellee", True), (4, None, None, "Mary Major", False, None, None, True),
            (5, "Law Office of X", "New London", None, False, "amicus curiae", None, False),
        ],
        key=str,
    )


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_spellings_against_all_pairs(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(300)] + ["Orr, P.A.", "orr PLLC", "Orr", "Or", "O.R.R. LLC", None, "PA", "..."]
    rows = spark.createDataFrame([(n,) for n in names], "firm string")
    got = {r["firm"]: r["known_as"] for r in counsel.same_names(rows, "firm").collect()}
    plain = {r["firm"]: r["p"] for r in rows.where("firm is not null").select("firm", counsel.plain_name(F.col("firm")).alias("p")).distinct().collect()}
    assert plain["Orr, P.A."] == plain["O.R.R. LLC"] == "orr" and plain["PA"] == "pa"
    count = {}
    for n in names:
        if n is not None:
            count[plain[n]] = count.get(plain[n], 0) + 1
    want = {n: min((-count[o], o) for o in count if near(o, p))[1] for n, p in plain.items()}
    assert got == want


def test_win_rates(spark):
    rows = spark.createDataFrame([(1, "F", "appellant"), (1, "F", "appellant"), (2, "F", "appellant"), (3, "F", "appellee"), (4, "F", "appellant"), (5, "F", None), (6, None, "appellee")], "case_number int, firm string, side string")
    cases = spark.createDataFrame([(1, "reversed"), (2, "affirmed"), (3, "affirmed"), (4, None), (5, "affirmed"), (6, "vacated")], "case_number int, outcome string")
    got = {(r["firm"], r["side"]): tuple(r)[2:] for r in counsel.win_rates(rows, cases).collect()}
    assert got == {("F", "appellant"): (3, 1, 1, 0.5), ("F", "appellee"): (1, 1, 0, 1.0)}
    assert counsel.win_rates(rows, cases, least=2).count() == 1
