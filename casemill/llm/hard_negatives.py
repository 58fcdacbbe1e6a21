"""Hard negatives by exact maximum-inner-product search in cover trees.

Candidates are dealt by a hash of their id over shards of bounded size; a task builds, for each
label of its shard, cover trees over the vectors augmented by one coordinate that gives all of a
tree the same norm M: the larger the inner product with an anchor, the smaller the distance.  Radii
are halved from level to level, points beyond the radius open nodes of their own, and each node keeps
the largest distance of what lies below it.  From it follow a least and a greatest inner product of
everything below; a best-first descent takes nodes by their greatest one, skips those outside every
window that is still open, and verifies the points of a node by exact integer products.

Anchors are sent to every shard (a stated set of queries against all rows) and stream through its
task in batches, so a task holds one shard and one batch.  Two passes: the first finds the positives
(trees of the anchor's label), the second the negatives (trees of other labels, with the score
windows of the positives).  Best rows of the shards are merged by a window over the anchor.

Defined cases: rows with a null id, label or vector, or with null or non-finite components take no
part; of rows that repeat an id the one with the least (label, vector) does.  Shorter vectors are
filled up with zeros.  Equal scores go to the smaller id.  An anchor without another row of its label,
or a positive without rows in its window, gives no rows (so does every negative positive score).
Scores are exact integers up to 2**52 in size.  Extra columns don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

#: Components of a shard's vectors (128 MB as 32-bit floats), points of one tree, points below which a node is not split.
SHARD_COMPONENTS = 1 << 25
TREE_POINTS = 4096
LEAF_POINTS = 24
#: Anchors that descend together.
BATCH_ANCHORS = 512


# Cover tree ----------------------------------------------------------------------------


@dataclass
class Node:
    """``radius`` covers all below; ``points`` are verified with the node, ``children`` are nodes."""

    center: int
    radius: float
    points: np.ndarray
    children: list[int]


class CoverTree:
    """Over integer vectors (rows of ``vectors``) with ascending ``ids``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        plain = vectors.astype(np.float64)
        squared = (plain**2).sum(axis=1)
        self.norm = float(np.sqrt(squared.max(initial=0.0)))
        lifted = np.sqrt(np.maximum(self.norm**2 - squared, 0.0))
        self._plain = np.concatenate([plain, lifted[:, None]], axis=1)
        self.nodes: list[Node] = []
        everything = np.arange(len(ids))
        far = self._distances(0, everything)
        waiting = [(self._node(0, far), everything, far, float(far.max(initial=0.0)))]
        while waiting:
            node, members, far, reach = waiting.pop()
            waiting += self._split(self.nodes[node], members, far, reach)
        del self._plain

    def _node(self, center: int, far: np.ndarray) -> int:
        self.nodes.append(Node(center, float(far.max(initial=0.0)), np.empty(0, dtype=np.int64), []))
        return len(self.nodes) - 1

    def _distances(self, center: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(((self._plain[members] - self._plain[center]) ** 2).sum(axis=1))

    def _split(self, node: Node, members: np.ndarray, far: np.ndarray, reach: float) -> list[tuple]:
        """Part the members of a node by centres half the level's radius apart; single points stay with the node."""
        if len(members) <= LEAF_POINTS or node.radius == 0.0:
            node.points = members
            return []
        half = reach / 2
        while node.radius <= half:  # levels on which the node is alone
            half /= 2
        near = far <= half
        groups = [(node.center, members[near], far[near])]
        rest = members[~near]
        while len(rest):
            center = int(rest[0])
            away = self._distances(center, rest)
            near = away <= half
            groups.append((center, rest[near], away[near]))
            rest = rest[~near]
        alone = [group for _, group, _ in groups if len(group) <= 2]
        node.points = np.sort(np.concatenate(alone)) if alone else node.points
        below = []
        for center, group, away in groups:
            if len(group) > 2:
                child = self._node(center, away)
                node.children.append(child)
                below.append((child, group, away, half))
        return below


@dataclass
class Anchors:
    """A batch that descends together; ``low`` and ``high`` have a column for each window."""

    vectors: np.ndarray
    norms: np.ndarray
    labels: np.ndarray
    own: np.ndarray  # ids that must not be found
    low: np.ndarray
    high: np.ndarray


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; in the smallest type whose sums are exact."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (a, b))
    if not (a.size and b.size):
        return np.zeros((len(a), len(b)))
    largest = float(np.sqrt((a.astype(np.float64) ** 2).sum(axis=1).max()) * np.sqrt((b.astype(np.float64) ** 2).sum(axis=1).max()))
    if largest < 1 << 23:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.float64)
    if largest < 1 << 52:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a.astype(object) @ b.astype(object).T


class Best:
    """The first ``k`` rows of each anchor and window so far: higher score first, then smaller id."""

    def __init__(self, anchors: int, windows: int, k: int):
        self.k = k
        self.scores = np.full((anchors, windows, k), -np.inf, dtype=object)
        self.ids = np.zeros((anchors, windows, k), dtype=np.int64)
        self.least = np.full((anchors, windows), -np.inf)  # a row must reach this score

    def offer(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, batch: Anchors) -> None:
        """``scores`` of the anchors ``at`` (rows) with the points ``ids`` (columns)."""
        blocked = batch.own[at][:, None] == ids[None, :]
        for w in range(self.least.shape[1]):
            fits = (scores >= np.maximum(batch.low[at, w], self.least[at, w])[:, None]) & (scores <= batch.high[at, w][:, None]) & ~blocked
            if not fits.any():
                continue
            if scores.shape[1] > 4 * self.k:  # only what is among the first k of its row
                held = np.where(fits, scores, -np.inf).astype(np.float64)
                kth = np.partition(held, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
                fits &= held >= kth[:, None]
            row, column = np.nonzero(fits)
            hit = np.unique(row)
            all_rows = np.concatenate([row, np.repeat(hit, self.k)])
            all_scores = np.concatenate([scores[row, column].astype(object), self.scores[at[hit], w].ravel()])
            all_ids = np.concatenate([ids[column], self.ids[at[hit], w].ravel()])
            if isinstance(scores, np.ndarray) and scores.dtype == object:
                order = np.array(sorted(range(len(all_rows)), key=lambda i: (all_rows[i], -all_scores[i], all_ids[i])))
            else:
                order = np.lexsort((all_ids, -all_scores.astype(np.float64), all_rows))
            sorted_rows = all_rows[order]
            rank = np.arange(len(order)) - np.searchsorted(sorted_rows, sorted_rows)
            order, rank, sorted_rows = order[rank < self.k], rank[rank < self.k], sorted_rows[rank < self.k]
            self.scores[at[sorted_rows], w, rank] = all_scores[order]
            self.ids[at[sorted_rows], w, rank] = all_ids[order]
            self.least[at[hit], w] = self.scores[at[hit], w, self.k - 1].astype(np.float64)


def descend(trees: list[tuple[int, CoverTree]], batch: Anchors, k: int, same_label: bool) -> Best:
    """Best-first over the nodes of all trees, for a batch of anchors at once."""
    best = Best(len(batch.own), batch.low.shape[1], k)
    waiting: list[tuple[float, int, int, int, np.ndarray, np.ndarray]] = []
    number = 0

    def push(tree: int, nodes: list[int], at: np.ndarray) -> None:
        nonlocal number
        cover = trees[tree][1]
        centers = cover.vectors[[cover.nodes[c].center for c in nodes]]
        scores = exact_products(batch.vectors[at], centers).astype(np.float64)
        radii = np.array([cover.nodes[c].radius for c in nodes])
        q = batch.norms[at][:, None]
        away = np.sqrt(np.maximum(q**2 + cover.norm**2 - 2 * scores, 0.0))
        slack = 1 + 1e-9 * q * cover.norm
        closest = np.maximum(away - radii, 0.0)
        most = np.minimum(scores + q * radii, (q**2 + cover.norm**2 - closest**2) / 2) + slack
        least = np.maximum(scores - q * radii, (q**2 + cover.norm**2 - (away + radii) ** 2) / 2) - slack
        for j, node in enumerate(nodes):
            keep = _open(best, batch, at, most[:, j], least[:, j])
            if keep.any():
                number += 1
                heapq.heappush(waiting, (-float(most[keep, j].max()), number, tree, node, at[keep], np.stack([most[keep, j], least[keep, j]])))

    for i, (label, _) in enumerate(trees):
        at = np.flatnonzero((batch.labels == label) == same_label)
        if len(at):
            push(i, [0], at)
    while waiting:
        _, _, tree, place, at, bounds = heapq.heappop(waiting)
        keep = _open(best, batch, at, bounds[0], bounds[1])
        at = at[keep]
        if not len(at):
            continue
        cover = trees[tree][1]
        node = cover.nodes[place]
        if len(node.points):
            best.offer(at, exact_products(batch.vectors[at], cover.vectors[node.points]), cover.ids[node.points], batch)
        if node.children:
            push(tree, node.children, at)
    return best


def _open(best: Best, batch: Anchors, at: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Anchors with a window that something of a node may still enter."""
    inside = (most[:, None] >= np.maximum(batch.low[at], best.least[at])) & (least[:, None] <= batch.high[at])
    return inside.any(axis=1)


# Spark ---------------------------------------------------------------------------------


def _finite(x: Column) -> Column:
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def integer_vectors(rows: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """``id``, ``label`` and ``v``, the components ``floor(scale * x)`` of the rows that take part; one row an id."""
    usable = F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, _finite)
    kept = rows.where(usable).select(
        F.col(key).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.transform(vector, lambda x: F.floor(scale * x.cast("double"))).alias("v"),
    )
    return kept.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(vectors.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


def shard_trees(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> list[tuple[int, CoverTree]]:
    """Trees of at most ``TREE_POINTS`` points, each of one label."""
    order = np.lexsort((ids, labels))
    ids, labels, vectors = ids[order], labels[order], vectors[order]
    if np.abs(vectors).max(initial=0) < 1 << 15:
        vectors = vectors.astype(np.int16)
    trees = []
    for label in np.unique(labels).tolist():
        a, b = np.searchsorted(labels, [label, label + 1])
        for low in range(int(a), int(b), TREE_POINTS):
            high = min(low + TREE_POINTS, int(b))
            trees.append((label, CoverTree(ids[low:high], vectors[low:high])))
    return trees


_ROW = "anchor_id long, window int, id long, score long"


def _searched(both: DataFrame, shards: int, k: int, same_label: bool) -> DataFrame:
    """``both`` holds candidates (``kind`` 0) and anchors (1) by shard; the first rows of every shard per anchor and window."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        trees: dict[int, list[tuple[int, CoverTree]]] = {}
        for batch in batches:
            kind, shard = (batch.column(c).to_numpy() for c in ("kind", "shard"))
            for s in np.unique(shard).tolist():
                part = pa.table(batch).filter(pa.array((shard == s) & (kind == 0))).combine_chunks()
                if part.num_rows:
                    trees.pop(s, None)
                    v = part.column("v").combine_chunks()
                    held.setdefault(s, []).append((part.column("id").to_numpy(), part.column("label").to_numpy(), _small(_matrix(v))))
                anchors = pa.table(batch).filter(pa.array((shard == s) & (kind == 1))).combine_chunks()
                if not anchors.num_rows or (s not in trees and s not in held):
                    continue
                if s not in trees:
                    parts = held.pop(s)
                    trees = {s: shard_trees(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), _stacked([p[2] for p in parts]))}
                for low in range(0, anchors.num_rows, BATCH_ANCHORS):
                    yield _rows(trees[s], anchors.slice(low, BATCH_ANCHORS), k, same_label)

    dealt = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(search, _ROW)


def _small(vectors: np.ndarray) -> np.ndarray:
    return vectors.astype(np.int16) if np.abs(vectors).max(initial=0) < 1 << 15 else vectors


def _rows(trees: list, part: pa.Table, k: int, same_label: bool) -> pa.RecordBatch:
    ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
    vectors = _matrix(part.column("v").combine_chunks())
    low, high = (_bounds(part.column(c).combine_chunks(), fill) for c, fill in (("low", np.inf), ("high", -np.inf)))
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    best = descend(trees, Anchors(vectors, norms, labels, ids, low, high), k, same_label)
    a, w, r = np.nonzero(best.scores != -np.inf)
    columns = [ids[a], w.astype(np.int32), best.ids[a, w, r], np.array([int(x) for x in best.scores[a, w, r]], dtype=np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "window", "id", "score"])


def _bounds(lists: pa.Array, fill: float) -> np.ndarray:
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.full((len(sizes), int(sizes.max(initial=0))), fill)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def mine_negatives(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    scale: int = 256,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """For each anchor (rows where ``anchors`` holds, a condition on ``id``) and each of its first ``positives``
    other rows of the same label, the first ``negatives`` rows of other labels with a score from ``low_percent``
    to ``high_percent`` of the positive's: anchor_id, positive_id, rank, negative_id and both scores."""
    spark = rows.sparkSession
    C.prepare(spark, batch_rows=2000)
    scratch = C.Scratch(spark)
    stored = scratch.table(integer_vectors(rows, key, vector, label, scale), "vectors")
    total, width = stored.agg(F.count("*"), F.max(F.size("v"))).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * max(width or 0, 1) // SHARD_COMPONENTS))
    none = F.array().cast("array<double>")
    candidates = stored.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "label", "v", none.alias("low"), none.alias("high"))

    def against_all(asked: DataFrame, k: int, same_label: bool) -> DataFrame:
        sent = asked.withColumns({"shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), "kind": F.lit(1)})
        found = _searched(candidates.unionByName(sent.select(candidates.columns)), shards, k, same_label)
        order = W.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    asked = stored.where(anchors)
    everything = asked.withColumns({"low": F.array(F.lit(float("-inf"))), "high": F.array(F.lit(float("inf")))})
    first = scratch.table(against_all(everything, positives, True).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # 50 p <= 100 s <= 95 p: one window for each positive, in the order of (score, id)
    windows = first.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("positive_score")).alias("s"), "positive_id"))).alias("p"))

    def percent(x: Column, up: bool, by: int) -> Column:
        """A hundredth of ``by`` times the positive's score, rounded to the inside of the window."""
        hundred = by * -x["s"]
        return (hundred + F.pmod(-hundred, F.lit(100)) if up else hundred - F.pmod(hundred, F.lit(100))) / 100

    asked = asked.join(windows, asked["id"] == windows["anchor_id"]).withColumns(
        {
            "low": F.transform("p", lambda x: percent(x, True, low_percent)),
            "high": F.transform("p", lambda x: percent(x, False, high_percent)),
        }
    )
    found = against_all(asked.select("id", "label", "v", "low", "high"), negatives, False)
    named = windows.select("anchor_id", F.posexplode("p").alias("window", "p"))
    return found.join(named, ["anchor_id", "window"]).select(
        "anchor_id",
        F.col("p.positive_id").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        (-F.col("p.s")).alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
