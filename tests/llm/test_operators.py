"""The ten operators against brute-force versions and on the defined corner cases."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casemill.llm import decontaminate, jaccard_join, license_scan, line_dedup, packing, quality_classifier, quality_rules, substring_dedup, text_model, token_ids, tokens, toxicity
from casemill.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = {"doc": 1, "fp": 2, "_bitmap": 3, "_hit": 4, "_later": 5, "n": 6, "cls": 7, "mark": 8, "key": 9, "fit": 10, "shard": 11, "_text": 12}


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1):
    """Documents with copies, near copies, shared lines and passages, null, empty and long texts and repeated rows."""
    rng = random.Random(seed)
    line, passage = "A shared  line here", " ".join(words(rng, 30))
    texts = []
    for i in range(60):
        body = words(rng, rng.randint(3, 120))
        t = " ".join(body)
        if i % 4 == 0:
            t += f"\n  {line.upper() if i % 8 else line} \nmore {i}"
        if i % 7 == 0:
            t += " " + passage
        texts.append(t)
    base = words(rng, 100)
    for _ in range(25):
        near = list(base)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(100)] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(near))
    texts += [texts[0]] * 6 + [None, "", "   \n\t", "one", "one two", " ".join(words(rng, 20_000, 5000)), "é ß ü É\nÉ"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(d, texts[k], "en" if k % 3 else None, f"s{k % 2}", len(texts[k] or "")) for d, k in enumerate(order)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).withColumns({k: F.lit(v) for k, v in CLASH.items()}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def split(text):
    return (text or "").encode().split()


# 1 quality rules


def test_statistics_against_brute_force(docs, empty):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, min_group=20).collect()}
    for d, t in texts_of(docs).items():
        w = split(t)
        windows = defaultdict(list)
        for i in range(len(w) - 4):
            windows[tuple(w[i : i + 5])].append(i)
        repeated = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        assert got[d]["n_words"] == len(w)
        assert got[d]["word_chars"] == sum(len(x.decode()) for x in w)
        assert got[d]["n_repeat_words"] == len(repeated)
        assert got[d]["n_dup_lines"] == len(lines) - len(set(lines))
        assert got[d]["base_failed"] == (len(w) < 10 or 100 * len(repeated) > 20 * len(w))
    assert quality_rules.quality_rules(empty).count() == 0


def test_outliers_are_found_and_the_rest_is_kept(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, rng.randint(40, 200))), "en", "s", 0) for i in range(300)]
    junk = [(1000 + i, " ".join(x + "###" for x in words(rng, 80)), "en", "s", 0) for i in range(20)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows + junk, SCHEMA)).collect()}
    assert not any(got[1000 + i] for i in range(20))
    assert sum(got[i] for i in range(300)) >= 298


def brute_outliers(x, residue, floors, support, steps, quantile, med, mad, subsets=(3, 17)):
    """Minimum covariance determinant in numpy: the same starts, concentration by whole distance bins, least determinant."""
    n, p = x.shape

    def estimate(rows):
        mu, cov = rows.mean(axis=0), np.cov(rows.T, bias=True).reshape(p, p)
        cov = cov + np.diag(np.maximum(np.square(floors) - np.diag(cov), 0) + 1e-9)
        return mu, np.linalg.inv(cov), np.linalg.slogdet(cov)[1]

    def bins(mu, inv):
        d = np.maximum(np.einsum("ij,jk,ik->i", x - mu, inv, x - mu), 0)
        return d, np.floor(np.log2(d + 1e-6) * quality_rules.BINS_PER_OCTAVE)

    def concentrate(mu, inv, _):
        b = bins(mu, inv)[1]
        edge = min(v for v in np.unique(b) if (b <= v).sum() >= n * support)
        return estimate(x[b <= edge])

    starts = [(np.round(med, 3), np.diag(1 / np.square(np.maximum(np.round(mad * 1.4826, 3), floors))), np.inf)]
    starts += [estimate(x[residue == k]) for k in subsets if (residue == k).sum() >= 4 * p]
    starts = [concentrate(*concentrate(*s)) for s in starts]
    best = min(starts, key=lambda s: s[2])
    for _ in range(2, steps):
        after = concentrate(*best)
        change, best = abs(after[2] - best[2]), after
        if change < quality_rules.TOLERANCE:
            break
    d, b = bins(*best[:2])
    edge = min(v for v in np.unique(b) if (b <= v).sum() >= n * 0.5)
    half = quality_rules.chi2_quantile(0.5, p)
    d = d * half / max(2 ** ((edge + 0.5) / quality_rules.BINS_PER_OCTAVE), half)
    return d, d > quality_rules.chi2_quantile(quantile, p), len(starts)


@pytest.mark.parametrize(("support", "steps"), [(0.75, 10), (0.5, 3), (1.0, 4)])
def test_outliers_against_brute_force(spark, support, steps):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 2)) @ np.array([[1.0, 0.6], [0.0, 0.8]]) + [3, -1]
    x[:200] = rng.normal(size=(200, 2)) * 0.3 + [9, 5]  # a cluster of outliers
    stats = spark.createDataFrame([(float(a), float(b), "g", "h", i) for i, (a, b) in enumerate(x)], "f0 double, f1 double, g0 string, g1 string, i int")
    rows = quality_rules.robust_outliers(stats, F.lit(True), ("f0", "f1"), (0.01, 0.01), support=support, steps=steps, min_group=10, quantile=0.999)
    out = rows.withColumn("residue", F.pmod(F.xxhash64("f0", "f1"), F.lit(32))).toPandas().sort_values("i")
    med = stats.agg(*(F.percentile_approx(c, 0.5, 2000) for c in ("f0", "f1"))).first()
    mad = stats.agg(*(F.percentile_approx(F.abs(F.col(c) - m), 0.5, 2000) for c, m in zip(("f0", "f1"), med, strict=True))).first()
    distance, outlier, starts = brute_outliers(x, out["residue"].to_numpy(), np.array([0.01, 0.01]), support, steps, 0.999, np.array(med), np.array(mad))
    assert starts == 3
    assert np.allclose(out["distance"].to_numpy(), distance, rtol=1e-6)
    assert np.array_equal(out["outlier"].to_numpy(), outlier)
    if support < 1:
        assert outlier[:200].all() and outlier[200:].mean() < 0.02


def test_covariance_decides_and_not_the_single_deviations(spark):
    """A row that is ordinary in each feature and odd in both together; a feature that is mostly zero."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 2)) @ np.array([[1.0, 0.97], [0.0, 0.24]]) * 0.01
    zeros = np.where(rng.random(2000) < 0.03, rng.random(2000) * 0.1, 0.0)
    rows = [(float(a), float(b), float(c), "g", "h", i) for i, ((a, b), c) in enumerate(zip(x, zeros, strict=True))]
    rows += [(0.015, -0.015, 0.0, "g", "h", 5000), (0.0, 0.0, 3.0, "g", "h", 5001), (0.02, 0.02, 0.0, "g", "h", 5002)]
    stats = spark.createDataFrame(rows, "f0 double, f1 double, f2 double, g0 string, g1 string, i int")
    out = {r["i"] for r in quality_rules.robust_outliers(stats, F.lit(True), ("f0", "f1", "f2")).where("outlier").collect()}
    assert {5000, 5001} <= out and 5002 not in out and len(out) < 20


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_fit_on_the_given_documents(spark):
    """The fitted rejections are not those of medians and deviations alone, floors lie under most variances, and texts in common form stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = quality_rules.C.Scratch(spark).table(quality_rules.text_statistics(docs), "statistics")
    rows = quality_rules.transformed(stats, ~failed)
    got = quality_rules.robust_outliers(rows, ~failed, min_group=100).where(~failed).toPandas()
    x = got[list(quality_rules.FEATURES)].to_numpy()
    mad = np.median(np.abs(x - np.median(x, axis=0)), axis=0) * 1.4826
    alone = np.square((x - np.median(x, axis=0)) / np.where(mad > 1e-9, mad, np.inf)).sum(axis=1) > quality_rules.chi2_quantile(0.999999, x.shape[1])
    assert 0 < got["outlier"].sum() < 0.08 * len(got)
    assert (got["outlier"].to_numpy() != alone).any()
    covered = np.cov(x[~got["outlier"].to_numpy()].T).diagonal()
    assert ((0.1 * mad[mad > 1e-9]) ** 2 < covered[mad > 1e-9]).all() and (mad > 1e-9).sum() >= 4


# 2 line dedup


def brute_lines(texts, min_docs, keep_first):
    key = lambda x: x.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).strip(b" \t\n\x0b\x0c\r")
    where = defaultdict(set)
    for d, t in texts.items():
        for x in (t or "").split("\n"):
            where[key(x)].add(d)
    out = {}
    seen = set()
    for d in sorted(texts):
        kept = []
        for x in (texts[d] or "").split("\n"):
            k = key(x)
            if k and len(where[k]) >= min_docs and not (keep_first and k not in seen):
                continue
            seen.add(k)
            kept.append(x)
        out[d] = "\n".join(kept)
    return out


@pytest.mark.parametrize(("min_docs", "keep_first"), [(10, False), (10, True), (2, True), (2, False), (1, False), (1, True)])
def test_lines_against_brute_force(docs, min_docs, keep_first):
    want = brute_lines(texts_of(docs), min_docs, keep_first)
    got = line_dedup.dedup_digest(docs, min_docs=min_docs, keep_first=keep_first).collect()
    assert {r["doc_id"]: r["kept_sha256"] for r in got} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in want.items()}


def test_deduped_documents_keep_their_columns(docs, empty):
    out = line_dedup.dedup_lines(docs, min_docs=10, keep_first=True)
    assert out.columns == docs.columns
    want, had = brute_lines(texts_of(docs), 10, True), texts_of(docs)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {d: t if had[d] is not None else None for d, t in want.items()}
    assert line_dedup.dedup_digest(empty).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(1, "x\ny"), (1, "x\ny"), (1, "x\nz"), (None, "x\nq"), (None, "x\nq"), (2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_dropped"]) for r in line_dedup.dedup_digest(df, min_docs=3, keep_first=False).collect())
    assert got == [(-1, 1), (-1, 1), (1, 1), (1, 1), (1, 1), (2, 1)]


# 3 decontamination


def brute_hits(texts, items, window):
    out = {}
    for d, t in texts.items():
        w = decontaminate.item_words(t)
        hit, which = set(), set()
        for i, x in items:
            for win in decontaminate.item_windows(decontaminate.item_words(x), window):
                for s in range(len(w) - len(win) + 1):
                    if tuple(w[s : s + len(win)]) == win:
                        hit.update(range(s, s + len(win)))
                        which.add(str(i))
        out[d] = (len(w), len(hit), len(which), hashlib.sha256(",".join(sorted(which)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_windows", [500_000, 7])
def test_contamination_against_brute_force(spark, docs, block_windows):
    texts = texts_of(docs)
    some = [t for t in texts.values() if t and len(t.split()) > 40][:4]
    items = [(i, " ".join(t.split()[5:22]).upper()) for i, t in enumerate(some)] + [(9, None), (10, ""), (11, "one two"), (12, "W3 w5"), (0, "w1")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.contamination_digest(docs, bench, block_windows=block_windows).collect()}
    assert got == brute_hits(texts, items, 10)


@pytest.mark.parametrize("block_windows", [500_000, 5])
def test_rows_are_judged_by_their_own_text(spark, block_windows):
    """Clean rows that share an id with a contaminated one, or have none, stay; an item without id counts, but is not listed."""
    rng = random.Random(6)
    item, clean = " ".join(words(rng, 12, 9000)), [" ".join(words(rng, 30, 9000)) for _ in range(3)]
    rows = [(1, f"a {item} b"), (1, clean[0]), (None, item), (None, clean[1]), (2, clean[2]), (2, clean[2]), (3, None), (4, f"{item} {item}"), (4, f"{item} {item}")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame([(None, item), (7, "of another text altogether " * 4)], "item_id long, text string")
    kept = decontaminate.decontaminate(df, bench, block_windows=block_windows)
    assert kept.columns == df.columns
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=str) == sorted([rows[1], rows[3], rows[4], rows[5], rows[6]], key=str)
    got = decontaminate.contamination_digest(df, bench, block_windows=block_windows).collect()
    assert len(got) == len(rows) and {r["n_items"] for r in got} == {0}
    assert sorted(r["n_hit"] for r in got) == [0, 0, 0, 0, 0, 12, 12, 24, 24]
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)


def test_special_strings_are_found_by_the_library(spark):
    rows = [(0, "<|endoftext|> a"), (1, "b <|startoftext|>c <|endoftext|>\n"), (2, "<|end of text|>"), (2, "x"), (2, "x"), (3, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    for name, leads, end in (("word_bpe_49k.json", False, 1), ("byte_bpe_50k.json", True, 0)):
        path = tokenizer_path(name)
        want = sorted(zlib.crc32(ids_of(path, {0: t}, end)[0].tobytes()) for _, t in rows)
        if leads:
            got = [r["ids_crc32"] for r in packing.pack(df, path, window=1 << 12).collect() if r["start"] == 0 and r["length"] == r["doc_tokens"]]
            assert set(got) <= set(want) and len(got) > 2
        else:
            assert sorted(r["ids_crc32"] for r in token_ids.token_digest(df, path, space_leads=False, end_id=1).collect()) == want


def test_no_benchmark_leaves_all_clean(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination_digest(docs, none).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs, none).count() == docs.count()
    assert decontaminate.contamination_digest(empty, none).count() == 0


# 4, 8 classifiers


def labelled(spark, n=600):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        w = words(rng, rng.randint(20, 80))
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        if toxic:
            w[3:3] = [rng.choice(toxicity.INSULTS + toxicity.CONTEMPT)] * 2
        if not good:
            w = [x + "$$$" for x in w]
        docs.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(good), int(toxic)))
    docs += [(n, None, "en", "s", 0), (n + 1, "", "en", "s", 0)]
    labels += [(n, None, None), (n + 5, 1, 0)]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r[1:] for r in labels[:n]}


def test_toxicity_on_held_out_rows(spark, empty):
    docs, labels, truth = labelled(spark)
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score_toxicity(docs, labels.where("doc_id is null or doc_id < 400")).collect()}
    held = [i for i in truth if i >= 400]
    assert np.mean([got[i] == bool(truth[i][1]) for i in held]) > 0.95
    assert not got[600] and not got[601]
    assert toxicity.score_toxicity(docs, labels.limit(0)).where("toxic").count() == 0
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_quality_on_held_out_rows(spark, empty):
    docs, labels, truth = labelled(spark)
    ratings = quality_classifier.graded(labels)
    rows = quality_classifier.grade_quality(docs, ratings.where("doc_id < 400")).collect()
    got = {r["doc_id"]: r for r in rows}
    held = [i for i in truth if i >= 400]
    assert np.mean([got[i]["kept"] == bool(truth[i][0]) for i in held]) > 0.95
    assert all(0 <= r["expected_grade"] <= 2 for r in rows)
    kept = {r["doc_id"] for r in quality_classifier.keep_good(docs, ratings.where("doc_id < 400")).collect()}
    assert kept == {d for d, r in got.items() if r["kept"]}
    assert quality_classifier.grade_quality(docs, ratings.limit(0)).where("kept").count() == docs.count()
    assert quality_classifier.grade_quality(empty, ratings).count() == 0


def test_ordinal_gradient():
    rng = np.random.default_rng(1)
    from casemill.llm.text_model import Design

    index = [np.array([1, 2]), np.array([2, 3]), np.array([1, 3]), np.array([1, 2, 3])] * 30
    share = [rng.random(len(i)).astype(np.float32) for i in index]
    y = np.array([int(i[0] == 1) + int(3 in i) for i in index])
    w, t = quality_classifier.fit_ordinal(Design(index, share), y, 3)
    assert np.all(np.diff(t) > 0)
    assert w[0] > w[1]


def test_grades_against_brute_force(spark, docs):
    """The model is the same in every run, and each whole text is scored by its own features."""
    table, labels, _ = labelled(spark)
    ratings = quality_classifier.graded(labels)
    model, again = (quality_classifier.train(table, r) for r in (ratings, ratings.repartition(7)))
    weights, thresholds, grades = model
    assert np.array_equal(weights, again[0]) and np.array_equal(thresholds, again[1]) and grades == again[2] == [0, 1, 2]
    mixed = table.select("doc_id", "text").union(docs.select(F.col("doc_id") + 10_000, "text"))
    got = {r["doc_id"]: r for r in quality_classifier.grade_quality(mixed.withColumn("n", F.lit(1)), ratings.where("doc_id < 10000")).collect()}
    for d, t in texts_of(mixed).items():
        index, share = text_model.document_features(t)
        s = float(weights[index].astype(float) @ share)
        below = 1 / (1 + np.exp(-(thresholds - s)))
        p = np.diff([0, *below, 1])
        assert abs(got[d]["expected_grade"] - p @ grades) < 2e-3
        assert abs(got[d]["tail_probability"] - p[1:].sum()) < 2e-3
        assert got[d]["kept"] == (p[1:].sum() >= 0.5) or abs(p[1:].sum() - 0.5) < 1e-3


def test_chain_against_brute_force(spark, docs):
    """The chain fitted by a plain loop over categories and folds, and probabilities from each text's features."""
    table, labels, _ = labelled(spark, 240)
    scratch = toxicity.C.Scratch(spark)
    rows = toxicity.training_table(table, labels, 4000, 3, "doc_id", "text", scratch)
    pdf = rows.toPandas().sort_values("row").reset_index(drop=True)
    assert len(pdf) == len(set(pdf["row"])) == 240
    index, share, fold = [np.asarray(x) for x in pdf["index"]], [np.asarray(x) for x in pdf["share"]], pdf["fold"].to_numpy()
    earlier, models = np.zeros((240, 0)), []
    for c in toxicity.CATEGORIES:
        design = text_model.Design(index, share, toxicity.log_odds(earlier), least=5, even=True)
        y, known, held_out = pdf[c].fillna(0).to_numpy(dtype=float), pdf[c].notna().to_numpy(), np.zeros(240)
        for k in (0, 1, 2, -1):
            learn = np.flatnonzero(known & (fold != k))
            w, d, b = text_model.fit_logistic(design.take(learn), y[learn])
            if k < 0:
                models.append((design.full(w), d, b))
            else:
                held_out[fold == k] = text_model.sigmoid(design.scores(w, d) + b)[fold == k]
        earlier = np.column_stack([earlier, held_out])
    mixed = table.select("doc_id", "text").union(docs.select(F.col("doc_id") + 10_000, "text"))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(mixed.withColumn("row", F.lit(1)), labels.where("doc_id < 10000")).collect()}
    for d, t in texts_of(mixed).items():
        i, x = text_model.document_features(t)
        p = []
        for w, dense, b in models:
            p.append(float(text_model.sigmoid(w[i].astype(float) @ x + toxicity.log_odds(np.array(p)) @ dense + b)) if len(i) else 0.0)
        assert np.allclose([got[d][f"p_{c}"] for c in toxicity.CATEGORIES], p, atol=5e-3)
        assert got[d]["toxic"] == (p[-1] >= 0.5) or abs(p[-1] - 0.5) < 5e-3


def test_training_rows_are_bounded_and_chosen_by_rule(spark):
    """Repeated ids and contradicting labels: one row for each id, the least label, whatever the order."""
    docs = spark.createDataFrame([(i % 50, f"text {i % 3} of {i % 50}", "x") for i in range(3000)] + [(None, "no id", "x")], "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(i % 50, i % 2, 0) for i in range(200)] + [(None, 1, 0), (77, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    some = [text_model.training_rows(docs.repartition(n), labels.repartition(n), ["quality", "toxic"], 20, "doc_id", "text").collect() for n in (2, 5)]
    assert len(some[0]) <= 20 and sorted(map(str, some[0])) == sorted(map(str, some[1]))
    assert len({r["doc_id"] for r in some[0]}) == len(some[0])
    assert all(r["quality"] == r["doc_id"] % 2 for r in some[0])


# 5, 10 token files and packing


def ids_of(path, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, end], dtype="<u4") for d, x in texts.items()}


def test_coding_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.random(n) ** 8 * (1 << 32)).astype(np.uint32)
        assert np.array_equal(token_ids.decode_ranks(*token_ids.encode_ranks(ranks), n), ranks)


def test_token_files_against_the_library(docs, empty):
    path, start = tokenizer_path("word_bpe_49k.json"), 0
    want = {}
    for d, ids in sorted(ids_of(path, texts_of(docs), 1).items()):
        want[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r["doc_id"]: tuple(r)[1:] for r in token_ids.token_digest(docs, path).collect()} == want
    assert token_ids.token_digest(empty, path).count() == 0


@pytest.mark.parametrize("window", [1024, 64])
def test_packing_places_every_id_once(docs, empty, window):
    path = tokenizer_path("byte_bpe_50k.json")
    want = ids_of(path, texts_of(docs), 0)
    rows = packing.pack(docs, path, window=window, shard_documents=30).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(r["ids"])
    for d, ids in want.items():
        assert b"".join(r["ids"] for r in sorted(by_doc[d], key=lambda r: r["start"])) == ids.tobytes()
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == window or (at & (at - 1)) == 0
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("name, space_leads", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_texts_tokenized_together(monkeypatch, name, space_leads):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "CACHE_PIECES", 40)
    monkeypatch.setattr(tokens, "GROUP_BYTES", 300)
    path = tokenizer_path(name)
    library, cached = Tokenizer.from_file(path), tokens.CachedTokenizer(path, space_leads)
    special = cached.special[:2]
    bits = ["the", "Wörter,", "don't", "x's", "it'", "the&&&", "a.$_#!", "12.5", "3rd", "_", "\u0120x", "\u0119l", "\u0142", "\u4e2d\u6587", "e\u0301t\u00e9.", "\u00aa", "\U0001f600!", "'ll", "A-B", "\x00q", "\x02,", "a\x02.", ",", *special]
    gaps = [" "] * 40 + ["\n"] * 8 + ["  ", "\n\n", " \n", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "\r\n"]
    rng = random.Random(8)
    texts = [None, "", " ", "\n", "\nthe", "the ", "x", *special]
    for k in range(400):
        own = bits[: len(bits) - len(special)] if k % 4 else bits
        text = "".join(x for _ in range(rng.randrange(1, 40)) for x in (rng.choice([rng.choice(own), f"{rng.choice(own)}{rng.choice(own)}", "".join(rng.choices("abcä", k=5))]), rng.choice(gaps[:48] if k % 3 else gaps)))
        texts.append(text.strip() if k % 2 else text)
    for _ in range(2):
        got = cached.many(pa.array(texts, pa.string()))
        assert [x.tolist() for x in got] == [library.encode(x or "", add_special_tokens=False).ids for x in texts]
        assert {x.dtype for x in got} == {np.dtype(cached.dtype)}
    assert len(cached.index) <= 40
    for x in texts:
        assert cached.ids(x or "").tolist() == library.encode(x or "", add_special_tokens=False).ids
    assert cached.many(pa.array([], pa.string())) == []


def test_new_words_are_encoded_in_one_call(monkeypatch):
    """New words of a batch go to the merge model together, not one by one for each text."""
    cached = tokens.CachedTokenizer(tokenizer_path("byte_bpe_50k.json"), True)
    calls = []
    monkeypatch.setattr(cached, "_word", lambda *a: calls.append(a))
    words = ["".join(x) + m for x in zip("abcdefgh" * 50, "zyxwvuts" * 50, "mnopqrst" * 50, strict=True) for m in ("", ",", "&&&")]
    cached.many(pa.array([f"Line {' '.join(words[i : i + 30])}" for i in range(0, len(words), 30)]))
    assert {a[0] for a in calls} <= {"Line"}


def test_neighbours_come_first():
    rng = np.random.default_rng(3)
    topics = [rng.integers(k * 100, k * 100 + 100, size=30) for k in range(6) for _ in range(5)]
    sequences = packing.pack_shard([t.astype(np.uint16) for t in topics], 150)
    same = sum(len({d // 5 for d, _, _ in s}) == 1 for s in sequences)
    assert same >= 5


def test_copies_share_windows_whatever_their_shard(spark):
    """Copies with far ids: of many shards each sees its own documents, so copies must be dealt together."""
    rng = random.Random(11)
    texts = [" ".join(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}{rng.randrange(50)}" for _ in range(60)) for _ in range(60)]
    rows = [(copy * 1000 + i, t) for copy in range(4) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = packing.pack(df, tokenizer_path("byte_bpe_50k.json"), window=256, shard_documents=24, with_ids=False).collect()
    windows = defaultdict(set)
    for r in got:
        windows[r["sequence_id"]].add(r["doc_id"])
    beside = {d: False for d, _ in rows}
    for w in windows.values():
        for d in w:
            beside[d] |= any(d != e and d % 1000 == e % 1000 for e in w)
    assert sum(beside.values()) > 0.7 * len(beside)


# 6 licences


def test_licences(spark, empty):
    rng = random.Random(7)
    notices = {"mit": "Released under the MIT License.", "apache": "Licensed under the Apache License, Version 2.0.", "gpl": "This work is licensed under the GNU General Public License, version 3."}
    rows = [(i, " ".join(words(rng, 30)) + "\n" + n, "en", "s", 0) for i, n in enumerate([*notices.values(), "He lost his licence in the public garden.", "plain"])]
    docs = spark.createDataFrame([*rows, (9, None, "en", "s", 0), (10, "", "en", "s", 0)], SCHEMA)
    got = {r["doc_id"]: r["license"] for r in license_scan.scan_licenses(docs).collect()}
    assert got == {0: "mit", 1: "apache", 2: "gpl", 3: "unknown"}
    assert license_scan.scan_licenses(empty).count() == 0
    assert all(any(a in t.lower() for a in license_scan.ANCHORS) for ts in license_scan.TEMPLATES.values() for t in ts)


def test_licences_without_an_anchor_word(spark):
    """Notices that hold none of the anchor words: a near wording, and a line wrapped after its anchor."""
    notices = {
        0: ("proprietary", "This document is confidential and proprietary."),
        1: ("mit", "granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        2: ("gpl", "under the terms of the General Foundation as published by the Free Software Foundation"),
        3: (None, "The garden in the back of the house is open to any person."),
        4: (None, "plain words of the house"),
    }
    assert not any(set(t.lower().strip(".").split()) & set(license_scan.ANCHORS) for _, t in notices.values())
    docs = spark.createDataFrame([(i, f"w1 w2 w3\n{t}", "en", "s", 0) for i, (_, t) in notices.items()], SCHEMA)
    rows = license_scan.scan_licenses(docs).where("confirmed").collect()
    got = {r["doc_id"]: r["license"] for r in rows}
    assert {0, 1} <= got.keys() and not {3, 4} & got.keys()
    assert all(got[i] == notices[i][0] for i in (0, 1))


def test_every_paragraph_against_brute_force(spark, docs):
    """Scores by the model's coefficients in numpy, pairs and anchors by Python sets, for every paragraph."""
    notices = [t for texts in license_scan.TEMPLATES.values() for t in texts] + list(license_scan.OTHER_SENSES)
    rng = random.Random(3)
    rows = [(1000 + i, f"{' '.join(words(rng, 8))}\n{' '.join(t.split()[i % 3 :])}\n\nplain words of the house", 1) for i, t in enumerate(notices)]
    table = docs.select("doc_id", "text", "n").unionByName(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    model, names, temperature = license_scan.train(table, "doc_id", "text", 2000, 1000, license_scan.C.Scratch(spark))
    split_words = lambda x: re.findall("[a-z0-9]+", x.lower())
    size, step = license_scan.WINDOW, license_scan.STEP
    parts = []
    for d, t in texts.items():
        for i, x in enumerate(t.split("\n") if t is not None else ()):
            w = split_words(x)
            parts += [(d, i, k, w[a : a + size]) for k, a in enumerate(range(0, max(1, len(w) - size + step), step))]
    lines = spark.createDataFrame(parts, "d long, i int, k int, w array<string>")
    raw = {}
    coefficients, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    for r in license_scan.featured(lines).collect():
        raw[r["d"], r["i"], r["k"]] = coefficients[:, r["features"].indices].sum(axis=1) + intercepts
    pairs = lambda w: set(zip(w, w[1:], strict=False))
    best = {}
    for d, i, k, w in parts:
        p = np.exp((raw[d, i, k] - raw[d, i, k].max()) / temperature)
        p /= p.sum()
        name = names[int(p.argmax())]
        if not w or (name == "unknown" and not set(w) & set(license_scan.ANCHORS)):
            continue
        known = [pairs(split_words(t)) for t in license_scan.TEMPLATES.get(name, ())]
        alike = max([len(pairs(w) & k) / max(1, min(len(pairs(w)), len(k))) for k in known], default=0.0)
        sure = name != "unknown" and p.max() >= 0.5 and alike >= 0.6
        best.setdefault((d, i), []).append((sure, name != "unknown", float(p.max()), -k, name, alike))
    whole = {}
    for d, i, _, w in parts:
        whole[d, i] = whole.get((d, i), [])
        whole[d, i].append(set(w) & set(license_scan.ANCHORS))
    best = {k: v for k, v in best.items() if len(whole[k]) == 1 or any(whole[k]) or max(v)[0]}
    want = {k: (b[4] if b[0] else "unknown", b[4], round(b[2], 3), round(b[5], 4), b[0]) for k, v in best.items() for b in [max(v)]}
    got = {(r["doc_id"], r["paragraph"]): (r["license"], r["predicted"], round(r["probability"], 3), r["similarity"], r["confirmed"]) for r in license_scan.scan_licenses(table).collect()}
    assert got.keys() == want.keys()
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-3 and a[3:] == b[3:] for a, b in ((got[k], want[k]) for k in want))
    found = [got.get((1000 + i, 1), ("",))[0] for i in range(len(notices))]
    family = [f for f, texts in license_scan.TEMPLATES.items() for _ in texts]
    assert np.mean([a == b for a, b in zip(found, family, strict=False)]) > 0.8
    assert set(found[len(family) :]) <= {"unknown", ""}


def test_notices_inside_long_paragraphs_and_titles(spark):
    rng = random.Random(4)
    notices = {"apache": "Licensed under the Apache License, Version 2.0.", "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"}
    rows, want = [], {}
    for size in (0, 50, 300, 1500, 20_000):
        for family, notice in notices.items():
            before, after = (" ".join(words(rng, size // 2 + k)) for k in (rng.randint(0, 30) if size else 0, 0))
            want[len(rows)] = family
            rows.append((len(rows), f"{before} {notice} {after}", "en", "s", 0))
    for family, title in (("mit", "MIT License"), ("epl", "Eclipse Public License - v 2.0"), ("boost", "Boost Software License - Version 1.0"), ("unlicense", "This is free and unencumbered software released into the public domain."), ("isc", "ISC License")):
        want[len(rows)] = family
        rows.append((len(rows), title, "en", "s", 0))
    rows += [(100 + i, " ".join(words(rng, 3000)), "en", "s", 0) for i in range(5)]
    found = {r["doc_id"]: r["license"] for r in license_scan.scan_licenses(spark.createDataFrame(rows, SCHEMA)).where("confirmed").collect()}
    assert found == want


# 7 Jaccard join


def brute_components(texts, size, percent):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("size", "percent", "leaf"), [(4, 85, 64), (5, 80, 4), (2, 60, 4)])
def test_components_against_brute_force(docs, size, percent, leaf):
    got = {r["doc_id"]: tuple(r)[1:] for r in jaccard_join.jaccard_components(docs, size, percent, buckets=1 << 16, leaf=leaf).collect()}
    assert got == brute_components(texts_of(docs), size, percent)


def test_one_of_each_group_stays(docs, empty):
    want = brute_components(texts_of(docs), 5, 80)
    kept = {r["doc_id"] for r in jaccard_join.first_of_each(docs, shingle=5, percent=80, buckets=1 << 16).collect()}
    assert kept == {d for d, (_, c) in want.items() if c == d}
    assert jaccard_join.jaccard_components(empty, buckets=1 << 16).count() == 0


def clustered_sets(rng, centres, each, n=60, changed=18):
    """Sets around centres, which are partly alike themselves; near members link, far ones don't."""
    common = rng.integers(1 << 40, 1 << 41, size=n // 6)
    sets = []
    for _ in range(centres):
        centre = np.concatenate([common, rng.integers(0, 1 << 40, size=n - n // 6)])
        for _ in range(each):
            k = rng.integers(0, changed)
            sets.append(np.unique(np.concatenate([rng.permutation(centre)[k:], rng.integers(0, 1 << 40, size=k)]).astype(np.uint64)))
    return sets


def brute_set_components(sets, percent):
    root = list(range(len(sets)))
    universe = np.unique(np.concatenate(sets))
    held = np.zeros((len(sets), len(universe)), dtype=np.float32)
    for i, s in enumerate(sets):
        held[i, np.searchsorted(universe, s)] = 1
    both, sizes = held @ held.T, held.sum(axis=1)
    root = np.arange(len(sets))
    for a, b in zip(*np.nonzero(100 * both >= percent * (sizes[:, None] + sizes[None] - both)), strict=True):
        if root[a] != root[b]:
            root[root == max(root[a], root[b])] = min(root[a], root[b])
    return root


@pytest.mark.parametrize(("centres", "each", "percent"), [(40, 35, 85), (40, 35, 70), (1, 1100, 85), (1200, 1, 85), (3, 2, 85)])
def test_region_join_against_brute_force(centres, each, percent):
    """Regions of over 1000 members; cells, window copies and recursion do happen."""
    sets = clustered_sets(np.random.default_rng(centres), centres, each)
    classes = np.random.default_rng(1).permutation(len(sets)).astype(np.int64)
    a, b, counts = jaccard_join.region_links(classes, sets, percent)
    got = np.arange(len(sets))
    got[a] = b
    by_class = [sets[i] for i in np.argsort(classes)]
    assert np.array_equal(got, brute_set_components(by_class, percent))
    if centres == 40 and percent == 85:
        assert counts["voronoi"] > 1 and counts["cells"] > 2
        assert counts["distances"] < len(sets) ** 2 / 4


def test_window_copies_are_made_and_needed():
    """A chain of sets, each close to the next one: neighbours lie on both sides of each boundary."""
    sets = [np.arange(i * 4, i * 4 + 60).astype(np.uint64) for i in range(300)]
    a, _, counts = jaccard_join.region_links(np.arange(300), sets, 85)
    assert len(a) == 299
    assert counts["copies"] > 0 and counts["voronoi"] > 10 and counts["cells"] > 10


@pytest.mark.parametrize("leaf", [6])
def test_regions_beyond_a_task(spark, leaf, monkeypatch):
    """The Spark job's Voronoi steps, single-shingle regions and rounds of pivots give the same components."""
    rng = random.Random(leaf)
    texts = {}
    shared = words(rng, 12, 10_000)
    for c in range(12):
        base = words(rng, 60, 10_000)
        for _ in range(12):
            near = list(base)
            for _ in range(rng.randint(0, 5)):
                near[rng.randrange(60)] = f"x{rng.randrange(100_000)}"
            texts[len(texts)] = " ".join(shared + near)
    for i in range(40):  # unlike texts that share a passage
        texts[len(texts)] = " ".join(words(rng, 20, 10_000) + shared + words(rng, 20, 10_000))
    monkeypatch.setattr(jaccard_join, "JOB_PIVOTS", 5)
    monkeypatch.setattr(jaccard_join, "HELD", 3)
    joins = []
    init = jaccard_join._Join.__init__
    monkeypatch.setattr(jaccard_join._Join, "__init__", lambda self, *a: (init(self, *a), joins.append(self))[0])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for percent in (85, 60):
        got = {r["doc_id"]: tuple(r)[1:] for r in jaccard_join.jaccard_components(df, 2, percent, buckets=1 << 16, leaf=leaf).collect()}
        assert got == brute_components(texts, 2, percent)
        assert joins[-1].steps["levels"] > 0 and joins[-1].steps["cells"] > 0


def test_repeated_and_missing_ids_in_groups(spark):
    """One row stays of repeated rows; a row without id gives way to its equals with one; other texts of a repeated id stay."""
    rng = random.Random(4)
    one, two, three = (" ".join(words(rng, 40, 9000)) for _ in range(3))
    rows = [(1, one), (1, one), (2, one), (2, two), (None, one), (None, three), (5, None), (5, None), (6, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, extra string")
    kept = jaccard_join.first_of_each(df, buckets=1 << 16)
    assert kept.columns == df.columns
    got = sorted([tuple(r)[:2] for r in kept.collect()], key=str)
    assert got == sorted([(1, one), (2, two), (None, three), (5, None), (5, None), (6, "")], key=str)


# 9 substring dedup


@pytest.mark.parametrize(("window", "anchor"), [(13, 6), (5, 3)])
def test_spans_against_brute_force(docs, empty, window, anchor):
    texts = {d: split(t) for d, t in texts_of(docs).items()}
    first = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - window + 1):
            first.setdefault(tuple(texts[d][i : i + window]), d)
    want = {}
    for d, w in texts.items():
        gone = {p for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for p in range(i, i + window)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        want[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.removal_digest(docs, window=window, anchor=anchor).collect()}
    assert got == want
    assert substring_dedup.removal_digest(empty).count() == 0
    # factors are words of an earlier document, as long as they can be there, and cover what is removed
    for r in substring_dedup.remove_spans(docs, window=window, anchor=anchor).collect():
        own, covered = texts[r["doc_id"]], set()
        for f in r["factors"]:
            ref, n = texts[f["ref"]], f["end"] - f["start"]
            assert f["ref"] < r["doc_id"] and n >= window
            assert own[f["start"] : f["end"]] == ref[f["ref_start"] : f["ref_start"] + n]
            covered.update(range(f["start"], f["end"]))
        assert len(covered) == want[r["doc_id"]][1]
        for f, g in zip(r["factors"], r["factors"][1:], strict=False):  # the next one does not go on where this one ended
            assert g["start"] > f["start"]
            assert (g["ref"], g["start"], g["ref_start"]) != (f["ref"], f["end"] - window + 1, f["ref_start"] + f["end"] - f["start"] - window + 1)


def test_factors_of_an_exact_copy_and_of_repeats(spark):
    rng = random.Random(8)
    one, two = words(rng, 60, 9000), words(rng, 60, 9000)
    loop = ["so", "it", "goes", "on", "and"] * 4000
    rows = [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(two[10:40] + one[5:50])), (4, " ".join(one)), (None, " ".join(one)), (5, " ".join(loop)), (6, " ".join(loop)), (7, None), (8, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, first int")
    got = {r["doc_id"]: r for r in substring_dedup.remove_spans(df).collect()}
    plain = lambda d: [tuple(f) for f in got[d]["factors"]]
    assert plain(3) == [(0, 30, 2, 10), (30, 75, 1, 5)]
    assert plain(4) == plain(None) == [(0, 60, 1, 0)]
    assert plain(1) == plain(2) == plain(5) == plain(7) == plain(8) == []
    assert got[6]["kept"] == "" and got[5]["kept"].count(" ") == len(loop) - 1


# Rows of every kind, for all operators


def test_odd_rows_and_clashing_columns(spark):
    """Repeated rows, rows without id or text, a very long text and columns with the operators' own names: one outcome per row, the same for equal rows."""
    rng = random.Random(12)
    one, two = " ".join(words(rng, 60)), " ".join(words(rng, 60)) + "\nReleased under the MIT License."
    rows = [(1, one), (1, one), (None, two), (None, two), (2, None), (3, ""), (4, " ".join(words(rng, 40_000, 3000))), (5, " \n\t ")]
    clash = ("n_words", "kept", "toxic", "w", "features", "start", "parts", "fit", "raw", "label", "row", "paragraph", "text_", "doc", "cls", "fp", "hit", "items", "n", "component", "_text", "mark", "grade", "anchor", "logdet")
    df = spark.createDataFrame([(*r, "en", None, 0) for r in rows], SCHEMA).withColumns({c: F.lit(1) for c in clash})
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(6)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(7, one), (None, "of another kind")], "item_id long, text string")
    results = {
        "op1": quality_rules.quality_rules(df), "op2": line_dedup.dedup_digest(df, min_docs=2), "op3": decontaminate.contamination_digest(df, bench), "op4": toxicity.score_toxicity(df, labels),
        "op5": token_ids.token_digest(df, tokenizer_path("word_bpe_49k.json")).drop("start"), "op7": jaccard_join.jaccard_components(df, buckets=1 << 16), "op8": quality_classifier.grade_quality(df, quality_classifier.graded(labels)),
        "op9": substring_dedup.removal_digest(df),
    }
    for name, out in results.items():
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(rows), name
        assert all(sum(r[0] == d for r in got) == n for d, n in ((1, 2), (None, 2), (2, 1), (3, 1), (4, 1), (5, 1))), name
        assert len({r for r in got if r[0] == 1}) == 1, name
        if name != "op9":
            assert len({r for r in got if r[0] is None}) == 1, name
    found = [(r["doc_id"], r["license"]) for r in license_scan.scan_licenses(df).collect()]
    assert found == [(None, "mit")] * 2
    pieces = packing.pack(df, tokenizer_path("byte_bpe_50k.json"), window=256).collect()
    assert sum(r["start"] == 0 for r in pieces) == len(rows)
