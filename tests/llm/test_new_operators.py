"""Hard negatives, piece encoding and periodic runs against brute force, the library and the defined cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from casemill.llm import hard_negatives, periodic_runs, sentence_pieces
from casemill.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string"
CLASH = ("doc", "ids", "starts", "ends", "runs", "collapsed", "tail_words", "tail_g", "best", "kind", "shard")


def clashing(df):
    """With columns whose names the operators use themselves."""
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})


# 11 hard negatives


def random_vectors(rng, n, spread):
    centers = rng.normal(size=(6, 7))
    v = np.floor((centers[rng.integers(0, 6, n)] + rng.normal(size=(n, 7)) * 0.2) * spread).astype(np.int64)
    v[rng.integers(0, n, n // 3)] = v[0]
    return v


@pytest.mark.parametrize("spread", [10, 10_000, 100_000_000])
@pytest.mark.parametrize("points,leaf", [(1000, 24), (50, 1)])
def test_descent_equals_full_scan(monkeypatch, spread, points, leaf):
    monkeypatch.setattr(hard_negatives, "TREE_POINTS", points)
    monkeypatch.setattr(hard_negatives, "LEAF_POINTS", leaf)
    rng = np.random.default_rng(spread + leaf)
    n = 400
    v, ids, labels = random_vectors(rng, n, spread), rng.permutation(3 * n)[:n], rng.integers(0, 3, n)
    trees = hard_negatives.shard_trees(ids, labels, v)
    a = np.arange(30)
    for same in (True, False):
        low = rng.integers(-100, 2000, (30, 2)) * float(spread) ** 2 / 100
        high = low + rng.integers(0, 3000, (30, 2)) * float(spread) ** 2 / 100
        norms = np.sqrt((v[a].astype(float) ** 2).sum(axis=1))
        best = hard_negatives.descend(trees, hard_negatives.Anchors(v[a], norms, labels[a], ids[a], low, high), 4, same)
        for i in a:
            s = [int(x) for x in v.astype(object) @ v[i].astype(object)]
            for w in range(2):
                rows = [j for j in range(n) if ids[j] != ids[i] and (labels[j] == labels[i]) == same and low[i, w] <= s[j] <= high[i, w]]
                wanted = sorted((-s[j], int(ids[j])) for j in rows)[:4]
                assert wanted == [(-int(x), int(y)) for x, y in zip(best.scores[i, w], best.ids[i, w], strict=True) if x != -np.inf]


def test_radii_cover_and_tight_groups_are_skipped():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 16)) * 3000
    v = np.floor(centers[np.arange(4000) % 40] + rng.normal(size=(4000, 16)) * 20).astype(np.int64)
    tree = hard_negatives.CoverTree(np.arange(4000), v)
    seen = np.concatenate([n.points for n in tree.nodes])
    assert sorted(seen.tolist()) == list(range(4000))
    below = {}

    def collect(i):
        node = tree.nodes[i]
        below[i] = np.concatenate([node.points, *[collect(c) for c in node.children]]).astype(int)
        return below[i]

    collect(0)
    for i, node in enumerate(tree.nodes):
        assert np.sqrt(((v[below[i]] - v[node.center]) ** 2.0).sum(axis=1)).max() <= node.radius + 1e-6
    verified = []
    offer = hard_negatives.Best.offer
    hard_negatives.Best.offer = lambda self, at, s, ids, batch: (verified.append(s.size), offer(self, at, s, ids, batch))
    try:
        one = hard_negatives.Anchors(v[:1], np.sqrt((v[:1] ** 2.0).sum(axis=1)), np.zeros(1), np.array([-1]), np.full((1, 1), -np.inf), np.full((1, 1), np.inf))
        hard_negatives.descend([(0, tree)], one, 5, True)
    finally:
        hard_negatives.Best.offer = offer
    assert sum(verified) < 1000  # of 4000


def brute_negatives(rows, anchors, positives, negatives):
    held = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        r = (label, [int(np.floor(256 * float(np.float32(c)))) for c in x])
        held[i] = min(held.get(i, r), r)
    score = lambda a, b: sum(x * y for x, y in zip(held[a][1], held[b][1], strict=False))
    out = []
    for a in filter(anchors, held):
        ranked = sorted((b for b in held if b != a), key=lambda b: (-score(a, b), b))
        same = [b for b in ranked if held[b][0] == held[a][0]][:positives]
        for p in same:
            fit = [b for b in ranked if held[b][0] != held[a][0] and 50 * score(a, p) <= 100 * score(a, b) <= 95 * score(a, p)]
            out += [(a, p, k + 1, b, score(a, p), score(a, b)) for k, b in enumerate(fit[:negatives])]
    return sorted(out)


def test_mined_negatives_with_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=6)], int(rng.integers(0, 4))) for i in range(-20, 280)]
    rows += [(i, rows[20][1], i % 4) for i in range(300, 330)]  # equal scores
    rows += [(5, rows[3][1], 1), (5, rows[3][1], 1), (400, [1.0, 2.0], 2), (401, [], 2), (402, None, 1), (403, [1.0, None], 1), (404, [float("nan")], 1)]
    rows += [(450, [float("inf")], 1), (None, [1.0], 1), (500, [1.0] * 6, None), (550, [0.0] * 6, 3), (600, [9.0] * 6, 77)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(7))
    got = hard_negatives.mine_negatives(df, F.col("id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, lambda i: i % 10 == 0, 5, 3)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert hard_negatives.mine_negatives(df.limit(0), F.col("id") % 10 == 0).count() == 0


# 12 pieces


def odd_texts(seed, n):
    rng = random.Random(seed)
    pool = [*"abcdefgh  ▁\n\t①ＫｱﾞÅéß漢字한글😀́​\xa0　ﬁ½.,;12<s>", "the", "tion", " of ", " in", "  ", "<0x0A>", "</s>", "\x00", "�", "क़"]
    return ["", " ", "  ", "▁", "x" * 500, " ab" * 300] + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def variants():
    plain = open(tokenizer_path("piece_bpe_32k.model"), "rb").read()
    yield plain
    m = pb.ModelProto()
    m.ParseFromString(plain)
    spec = pb.NormalizerSpec()
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec())
    m.normalizer_spec.precompiled_charsmap = spec.precompiled_charsmap
    m.normalizer_spec.remove_extra_whitespaces = True
    yield m.SerializeToString()
    m.ParseFromString(plain)
    m.normalizer_spec.remove_extra_whitespaces = True
    m.normalizer_spec.add_dummy_prefix = False
    yield m.SerializeToString()
    m.ParseFromString(plain)
    m.trainer_spec.byte_fallback = False
    for p in m.pieces:
        if p.type == pb.ModelProto.SentencePiece.BYTE:
            p.type, p.piece = pb.ModelProto.SentencePiece.NORMAL, "zzq" + p.piece
    yield m.SerializeToString()


@pytest.mark.parametrize("k", range(4))
def test_ids_spans_and_text_as_the_library(k):
    proto = list(variants())[k]
    theirs, ours = sentencepiece.SentencePieceProcessor(model_proto=proto), sentence_pieces.PieceModel(proto=proto)
    for t in odd_texts(k, 1500):
        ids, starts, ends = ours.encode(t)
        assert ids.tolist() == theirs.encode(t), t
        pieces = theirs.encode(t, return_type="proto").pieces
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(p.begin, p.end) for p in pieces], t
        assert ours.decode(ids.tolist()) == theirs.decode(ids.tolist()), t
    rng = random.Random(k)
    for _ in range(300):
        ids = [rng.choice([0, 1, 2, 259, rng.randrange(3, 200), rng.randrange(32000)]) for _ in range(rng.randint(0, 8))]
        assert ours.decode(ids) == theirs.decode(ids), ids


def test_piece_digest(spark):
    texts = [*odd_texts(9, 60), None, " ".join(f"w{i % 977}" for i in range(50_000)), "漢" * 3000]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "no id")]
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3))
    path = tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for d, t in rows:
        ids = lib.encode(t or "")
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), lib.decode(ids))]
        want.append((d, len(ids), *digests, len((t or "").encode())))
    got = sentence_pieces.piece_digest(df, path)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    assert sentence_pieces.piece_digest(df.limit(0), path).count() == 0


# 13 runs


def brute_runs(w, length=2, exponent=2):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q:
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in out.items() if b - a >= max(length, exponent * q))


def periodic(rng, n, kinds):
    w = [rng.randrange(kinds) for _ in range(n)]
    u = [rng.randrange(kinds) for _ in range(rng.randint(1, 15))]
    at = rng.randint(0, n)
    return w[:at] + (u * 40)[: rng.randint(0, 90)] + w[at:]


def test_catcher_in_one_call_or_word_by_word():
    rng = random.Random(4)
    for _ in range(400):
        w = periodic(rng, rng.randint(0, 100), rng.choice([1, 2, 3, 5, 20]))
        want = [(a, a + n, q) for a, n, q in brute_runs(w)]
        at_once, online = periodic_runs.SquareCatcher(), periodic_runs.SquareCatcher()
        at_once.append(np.array(w, dtype=np.int64))
        i = 0
        while i < len(w):
            j = i + rng.choice([1, 1, 2, 9, 40])
            online.append(np.array(w[i:j], dtype=np.int64))
            i = j
        assert at_once.runs() == want and online.runs() == want, w


def test_long_repetitive_texts_stay_fast():
    for w in (np.zeros(300_000), np.tile(np.arange(700), 400)):
        catcher = periodic_runs.SquareCatcher(len(w) // 3)
        catcher.append(w.astype(np.int64))
        assert len(catcher.runs()) == 1


def test_run_digest(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{x}" for x in periodic(rng, rng.randint(0, 90), rng.choice([2, 4, 30]))) for _ in range(150)]
    texts += [None, "", " \n\t ", "a", "a " * 24, "a　b " * 40, "x y z " * 30_000, " ".join(f"w{i}" for i in range(20_000))]
    rows = list(enumerate(texts)) + [(7, texts[7]), (None, texts[9])]
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want = []
    for d, t in rows:
        w = (t or "").encode().split()
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        g = h // 10
        if h % 10 == 0 and w:
            n = len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if len(w) > 1000:
            runs = [(0, len(w), 3)] if w[0] == b"x" else []
            if h % 10 == 0:
                runs = periodic_runs.runs_of([w], 24, 3)[0]
        else:
            runs = brute_runs(w, 24, 3)
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
        listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((d, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    digest = periodic_runs.run_digest(periodic_runs.repeated_tails(df))
    assert digest.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, (tuple(r) for r in digest.collect()))) == sorted(map(repr, want))
    assert sum(r[1] > 0 for r in want) > 20
    assert periodic_runs.run_digest(periodic_runs.repeated_tails(df.limit(0))).count() == 0


# 7 near copies without id


def test_near_copies_without_id_are_linked(spark):
    from casemill.llm import jaccard_join

    rng = random.Random(1)

    def near(base, k):
        w = list(base)
        w[k] = f"x{k}"
        return " ".join(w)

    one, two = ([f"{p}{rng.randrange(10_000)}" for _ in range(200)] for p in "ab")
    rows = [(None, near(one, 5)), (None, near(one, 190)), (7, near(one, 100)), (None, near(two, 3)), (None, near(two, 120)), (None, near(two, 120)), (9, "nothing like the others at all"), (None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in jaccard_join.jaccard_components(df, 4, 85).collect())
    assert got == sorted([("7", "7"), ("9", "9"), ("None", "7"), ("None", "7"), ("None", "None"), ("None", "None"), ("None", "None"), ("None", "None")])
    kept = [r["text"] for r in jaccard_join.first_of_each(df, 4, 85).collect()]
    assert near(one, 100) in kept and sum((t or "").startswith("a") for t in kept) == 1
    assert sum((t or "").startswith("b") for t in kept) == 1 and None in kept and len(kept) == 4
