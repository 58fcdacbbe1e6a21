"""Column functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from casemill.functions import clean as N


def values(spark, column, rows, ddl="x string"):
    out = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {ddl}").select("i", column(F.col("x")).alias("y"))
    return [r["y"] for r in out.orderBy("i").collect()]


def test_outcome(spark):
    assert values(spark, N.normalize_outcome, [" Remaned ", "AFFIRMED", None]) == ["remanded", "affirmed", None]


def test_summary_loses_one_run_at_each_end(spark):
    assert values(spark, N.clean_summary, [' ["(Held) that"] ', "a�b", None]) == ["Held) that", "ab", None]


def test_citations(spark):
    rows = [["RSA chapter 91-A", "RSA  91-A", "RSA chapters", "RSA chapters 5"], [], None]
    assert values(spark, N.clean_citations, rows, "x array<string>") == [["RSA 91-A", "RSA chapters 5"], [], None]


def test_name_repair_is_unicode_aware(spark):
    assert values(spark, N.repair_name, ["O�Brien", "é�à", "�X"]) == ["O'Brien", "é'à", "�X"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("the Merrimack Superior Court (Smith, J.) Case No. 5", "Merrimack Superior Court (Smith, J.)"),
        ("Rockingham Superior Court (Quigley", "Rockingham Superior Court"),
        ("by the superior court below", "Superior Court"),
        ("10th Circuit Court - Derry (Jones, J.); more\nnext", "10th Circuit Court - Derry (Jones, J.)"),
        ("United States and US District Court of", "U.S. District Court"),
        ("no such place", None),
        ("", None),
        (None, None),
    ],
)
def test_court(spark, raw, clean):
    assert values(spark, N.normalize_court, [raw]) == [clean]


def test_court_parts(spark):
    rows = ["Hillsborough Superior Court (O’Neill, C.J.)", "Nashua Family Court; x", "9th Circuit Court - Family Division"]
    assert values(spark, N.court_base, rows) == ["Hillsborough Superior Court", "Family Court", "9th Circuit Court - Family Division"]
    assert values(spark, N.court_judge, rows) == ["O’Neill", None, None]
    assert values(spark, lambda c: N.court_group(N.court_type(N.court_base(c))), rows) == ["Superior Court", "Family Court", "Circuit Court"]


def test_markers_and_inference(spark):
    rows = [
        (0, "State v. Doe", None, ("criminal", "high", "state_v_case_name")),
        (1, "In re Custody of A", [], ("family/domestic", "high", "family_keyword_case_name")),
        (2, "A v. B", ["RSA 458-C:3", "RSA 461-A:6"], ("family/domestic", "medium", "family_rsa_marker")),
        (3, "A v. B", ["RSA 631:2"], ("criminal", "medium", "criminal_rsa_marker")),
        (4, "A v. B", ["RSA 631:2", "RSA 458:1"], (None, "none", "insufficient_signals")),
        (5, "A.B. v. C.D.", None, ("family/domestic", "low", "initials_case_name_pattern")),
        (6, "a.b. v. c.d.", None, (None, "none", "insufficient_signals")),
        (7, None, ["RSA 458-C:3"], (None, "none", "insufficient_signals")),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "i int, name string, cites array<string>")
    got = df.select("i", N.infer_case_type(F.col("name"), F.col("cites")).alias("g")).orderBy("i").collect()
    assert [tuple(r["g"]) for r in got] == [r[3] for r in rows]


def test_default_type(spark):
    rows = ["State of New Hampshire v. X", "In the Matter of X", "A.B. v. C.D.", "X v. State of New Hampshire", "X v. Y", None]
    got = values(spark, lambda c: N.default_case_type(c)["case_type"], rows)
    assert got == ["criminal", "family/domestic", "family/domestic", "criminal", "civil", "civil"]


def test_labels_and_lists(spark):
    assert values(spark, N.outcome_label, ["reversed_and_remanded", "set_aside", None]) == ["Reversed & Remanded", "Set Aside", None]
    assert values(spark, N.case_type_label, ["domestic", "family/other"]) == ["Family/Domestic", "Family/Other"]
    assert values(spark, N.list_column, ["['RSA 91-A:8, IV', \"O'Brien\", ' ']", "[broken", None]) == [["RSA 91-A:8, IV", "O'Brien"], [], []]
    assert values(spark, N.docket_list, ["2024-0722-2024-0723", "x"]) == [["2024-0722", "2024-0723"], []]
    assert values(spark, N.us_date, ["12/28/2011", "bad"])[1] is None
    assert values(spark, N.preview, ["x" * 300])[0] == "x" * 260 + "..."


def test_case_group_takes_the_first_telling_citation(spark):
    df = spark.createDataFrame([("", None, ["RSA 91-A", "RSA 631:2", "RSA 458:1"]), (None, ["criminal"], []), ("domestic", ["criminal"], [])], "t string, topics array<string>, c array<string>")
    got = [r[0] for r in df.select(N.case_group(F.col("t"), F.col("topics"), F.col("c"))).collect()]
    assert got == ["criminal", "criminal", "family/domestic"]


def test_intro_excerpt(spark):
    text = "HEAD\nDONOVAN, J. The case\n\n\n\nbegins here.\nBackground\nrest"
    assert values(spark, N.intro_excerpt, [text, "x" * 5000, None]) == ["The case\n\nbegins here.", "x" * 3000, ""]
