"""N-gram Jaccard join in a metric space: pivots, Voronoi regions and triangle-inequality windows.

Jaccard distance d = 1 - J is a metric, and two documents link if d <= eps.  The join goes from
coarse to fine regions, and every link lies inside a region of each level:

1. *Coarse regions.*  Unrelated texts have d = 1, so a document drawn from the whole corpus as a
   pivot would put nearly every other one on a boundary.  The pivots of this level are single
   shingles: a set is equally near to all shingles it holds, and of these boundary copies only
   the n - ceil(t n) + l rarest are needed, as two linked sets share l of them.  Regions that
   share a document are merged, so that each set is sent once; a document whose copies meet
   fewer than l others has no link and is left out.
2. *Regions that fit a task* (``Region``): the members' distances to pivot documents make Voronoi
   cells.  A linked pair is together in a cell if members go to every cell with
   d(x, p) <= d(x, nearest) + 2 eps; with T = ``FAR``, cells also end at T + eps, and members with
   d > T from all pivots go to a cell of their own.  The cells are joined in the same way,
   recursively, down to ``FEW`` members, whose pairs are compared.
3. *Larger regions* take the same step as a Spark job: their members are dealt into salted chunks,
   the region's pivot sets go to each chunk, and a cell is a region of the next level.  A cell of
   far ones that still is too large is parted by the pairs that share enough rare shingles.

A cell that a step does not make smaller is settled by pivots: members of the smallest components
are compared with all members of other components whose size and pivot distances admit a link
(in a Spark job, chunk by chunk and in blocks of pivots), until one component is left or every
other member has been a pivot.  Components need no pairs inside a component, so a group of
thousands of near copies costs about as many distances as it has members.

Rarity is the count of documents in one of 2^k hash buckets, summed over all documents.  Any order
gives the same result; at n shingles a bucket the noise is about sqrt(n), above which the common
shingles, the only ones that matter, stand out.  Shingles are 64-bit fingerprints, classes of equal
sets are named by 64 bits of a 128-bit one.

Defined cases: null or empty texts have the empty set and link with nothing.  Fewer words than a
shingle are one shingle of all words.  Equal sets are one class, whatever its size, and take part
once; so repeated rows cost nothing.  Repeated ids are one node.  Rows without id join the
component of a class that has an id, else their component is null.  Very long texts are one set.
Ties in distance or rarity go to the smaller fingerprint.  An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C
from .components import connected_components

SLICE = 1 << 16
#: Beyond this distance from every pivot a member goes to the cell of far ones.
FAR = 0.5
#: Members of a cell whose pairs are compared one by one.
FEW = 4
#: Members of a token's group up to which its pairs are counted.
HELD = 16
#: Pivots of one Voronoi step inside a task (the square root of the members, if more), and in a Spark job.
PIVOTS, JOB_PIVOTS = 8, 32


def _document_set(text: object, size: int) -> np.ndarray:
    return C.shingle_set(C.encoded(text).translate(C.LOWER).split(), size)


def _class_id(shingles: np.ndarray) -> int:
    return int.from_bytes(C.digest128(shingles.tobytes())[:8], "little", signed=True)


def _profiled(batches: Iterator[pd.DataFrame], size: int, buckets: int) -> Iterator[pd.DataFrame]:
    """Set size and class of every document (kind 0), then the task's bucket counts in slices (kind 1)."""
    counts = np.zeros(buckets, dtype=np.uint32)
    columns = ["kind", "doc", "fp", "n", "cls", "slice", "counts"]
    for pdf in batches:
        rows = []
        for doc, fp, text in zip(pdf["doc"], pdf["fp"], pdf["text"], strict=True):
            s = _document_set(text, size)
            if len(s):
                np.add.at(counts, (s & np.uint64(buckets - 1)).astype(np.int64), 1)
            rows.append((0, doc, fp, len(s), _class_id(s) if len(s) else None, None, None))
        yield pd.DataFrame(rows, columns=columns, dtype=object)
    for i in range(0, buckets, SLICE):
        part = counts[i : i + SLICE]
        if part.any():
            yield pd.DataFrame([(1, None, None, None, None, i // SLICE, zlib.compress(part.tobytes(), 1))], columns=columns, dtype=object)


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals: dict[int, np.ndarray] = {}
    for pdf in batches:
        for i, packed in zip(pdf["slice"], pdf["counts"], strict=True):
            part = np.frombuffer(zlib.decompress(packed), dtype=np.uint32).astype(np.uint64)
            totals[i] = totals[i] + part if i in totals else part
    yield pd.DataFrame(
        [(i, zlib.compress(np.minimum(v, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)) for i, v in totals.items()], columns=["slice", "counts"]
    )


def least_shared(n: int) -> int:
    """How many tokens of their prefixes two linked sets, of which the smaller has ``n`` shingles, are to share."""
    return min(max(n // 8, 1), max(16, n // 16))


def least_shared_column(n: Column) -> Column:
    return F.least(F.greatest(F.floor(n / 8), F.lit(1)), F.greatest(F.lit(16), F.floor(n / 16)))


def prefix_length(n: int, percent: int) -> int:
    """Of ``n`` shingles in a common order, so many first ones: linked sets share ``least_shared`` of them.

    A linked set lacks at most n - ceil(t n) of the n shingles, wherever they stand.
    """
    return min(n, n - (percent * n + 99) // 100 + least_shared(n))


def _prefixed(batches: Iterator[pd.DataFrame], size: int, percent: int, rarity) -> Iterator[pd.DataFrame]:
    counts = rarity.value
    mask = np.uint64(len(counts) - 1)
    seen: set[int] = set()  # classes already written by this task; only saves repeats
    for pdf in batches:
        tokens, classes = [], []
        for text in pdf["text"]:
            s = _document_set(text, size)
            cls = _class_id(s) if len(s) else None
            if cls is None or cls in seen:
                continue
            if len(seen) < 100_000:
                seen.add(cls)
            k = prefix_length(len(s), percent)
            # by (count, fingerprint): s is sorted by fingerprint and the sort is stable
            rare = s[np.argsort(counts[(s & mask).astype(np.int64)], kind="stable")[:k]]
            tokens.append(rare.view(np.int64))
            classes.append(np.full(k, cls, dtype=np.int64))
        if tokens:
            yield pd.DataFrame({"token": np.concatenate(tokens), "cls": np.concatenate(classes)})


# One region in one task ------------------------------------------------------------------


class Region:
    """The sets of one region, the components found so far and what was done (``counts``)."""

    def __init__(self, sets: list[np.ndarray], percent: int, pivots: int = PIVOTS, few: int = FEW):
        self.percent, self.eps, self.pivots, self.few = percent, 1 - percent / 100, pivots, few
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        universe, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(universe), dtype=bool)
        self.root = np.arange(len(sets))
        self.counts: Counter[str] = Counter()

    def overlaps(self, one: int, others: np.ndarray) -> np.ndarray:
        """Shingles that ``one`` shares with each of the others."""
        self.counts["distances"] += len(others)
        own = self.flat[self.bounds[one] : self.bounds[one + 1]]
        self.mark[own] = True
        sizes = self.sizes[others]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.bounds[others] - (ends - sizes), sizes)
        both = np.add.reduceat(self.mark[self.flat[at]], ends - sizes, dtype=np.int64)
        self.mark[own] = False
        return both

    def compare(self, one: int, others: np.ndarray) -> np.ndarray:
        """Distances of one member to others; links join their components."""
        both = self.overlaps(one, others)
        union = self.sizes[one] + self.sizes[others] - both
        hit = np.unique(self.root[others[100 * both >= self.percent * union]])
        if len(hit):
            self.root[np.isin(self.root, hit)] = self.root[one]
        return 1 - both / union

    def admitted(self, one: int, others: np.ndarray) -> np.ndarray:
        """Those of another component whose size admits a link."""
        a, b = self.sizes[one], self.sizes[others]
        return others[(self.root[others] != self.root[one]) & (100 * np.minimum(a, b) >= self.percent * np.maximum(a, b))]

    def settled(self, cell: np.ndarray) -> bool:
        return len(cell) < 2 or bool((self.root[cell] == self.root[cell[0]]).all())

    def join(self, cell: np.ndarray) -> None:
        """All links between the members of a cell, as far as they join components."""
        work = [cell]
        while work:
            cell = work.pop()
            if self.settled(cell):
                continue
            if len(cell) <= self.few:
                for i, one in enumerate(cell[:-1].tolist()):
                    others = self.admitted(one, cell[i + 1 :])
                    if len(others):
                        self.compare(one, others)
                continue
            self.counts["voronoi"] += 1
            chosen, distance = self.spread(cell)
            rest = np.setdiff1d(np.arange(len(cell)), chosen, assume_unique=True)
            cell, distance = cell[rest], distance[:, rest]
            if self.settled(cell):
                continue
            near = distance.min(axis=0)
            window = np.minimum(near + 2 * self.eps, FAR + self.eps) + 1e-9
            cells = [np.flatnonzero(d <= window) for d in distance] + [np.flatnonzero(near > FAR)]
            cells = [c for c in cells if len(c) > 1]
            copies = sum(map(len, cells))
            if sum(len(c) ** 2 for c in cells) <= 0.9 * len(cell) ** 2 and copies <= 2 * len(cell):
                self.counts["cells"] += len(cells)
                self.counts["copies"] += max(0, copies - len(np.unique(np.concatenate(cells)))) if cells else 0
                work += [cell[c] for c in cells]
            else:
                self.exhaust(cell, distance)

    def spread(self, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of pivots, each far from those before it, and every member's distances to them."""
        chosen, rows = [0], [self.compare(int(cell[0]), cell)]
        for _ in range(min(max(self.pivots, int(len(cell) ** 0.5)), len(cell) // 2) - 1):
            near = np.minimum.reduce(rows)
            far = int(np.argmax(near))
            if near[far] <= self.eps:
                break
            chosen.append(far)
            rows.append(self.compare(int(cell[far]), cell))
        return np.array(chosen), np.array(rows)

    def exhaust(self, cell: np.ndarray, distance: np.ndarray) -> None:
        """Members of the smallest components as pivots, until one component is left."""
        self.counts["exhausted"] += 1
        label, size = np.unique(self.root[cell], return_counts=True)
        held = size[np.searchsorted(label, self.root[cell])]
        order = np.argsort(held, kind="stable")
        alive = np.ones(len(cell), dtype=bool)
        for at in order.tolist():
            alive[at] = False
            left = np.flatnonzero(alive)
            if self.settled(np.append(cell[left], cell[at])):
                return
            near = left[(np.abs(distance[:, left] - distance[:, [at]]) <= self.eps + 1e-9).all(axis=0)]
            others = self.admitted(int(cell[at]), cell[near])
            if len(others):
                self.compare(int(cell[at]), others)


def _arrays(column) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in column]


def region_links(classes: np.ndarray, sets: list[np.ndarray], percent: int, **options) -> tuple[np.ndarray, np.ndarray, Counter]:
    """Each class that is linked and the least class of its component in this region."""
    classes, first = np.unique(classes, return_index=True)
    if len(classes) < 2:
        return classes[:0], classes[:0], Counter()
    region = Region([sets[i] for i in first], percent, **options)
    region.join(np.arange(len(classes)))
    _, first, part = np.unique(region.root, return_index=True, return_inverse=True)
    least = classes[first][part]  # classes ascend, so the first of a component is its least
    moved = least != classes
    return classes[moved], least[moved], region.counts


# A step of a larger region as a Spark job -------------------------------------------------


def _to_pivots(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's members (left) and then the pivots (right): classes, those of the pivots, distances and links (pivots x both)."""
    left, right = left.drop_duplicates("cls"), right.drop_duplicates("cls").sort_values("cls")
    region = Region(_arrays(left["shingles"]) + _arrays(right["shingles"]), percent)
    n, every = len(left), np.arange(len(left) + len(right))
    rows, links = [], []
    for p in range(len(right)):
        both = region.overlaps(n + p, every)
        union = region.sizes[n + p] + region.sizes - both
        rows.append(1 - both / union)
        links.append(100 * both >= percent * union)
    return np.concatenate([left["cls"], right["cls"]]), right["cls"].to_numpy(), np.array(rows), np.array(links)


def _separate(distance: np.ndarray) -> list[int]:
    """Of the pivots those that are farther than ``FAR`` from each one taken before."""
    taken: list[int] = []
    for p in range(len(distance)):
        if all(distance[p, q] > FAR for q in taken):
            taken.append(p)
    return taken


def _celled(percent: int):
    """Links (``a, b``) of a chunk and the Voronoi cells of each member ``a`` (by pivot; 0 is the far one)."""
    eps = 1 - percent / 100

    def measure(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame([], columns=["region", "a", "b", "cells"])
        cls, pivots, distance, links = _to_pivots(left, right, percent)
        n = len(left["cls"].unique())
        p, m = np.nonzero(links[:, :n])
        found = pd.DataFrame({"a": cls[m], "b": pivots[p], "cells": None})
        taken = _separate(distance[:, n:])
        rest = np.flatnonzero(~np.isin(cls[:n], pivots))
        near = distance[taken][:, rest].min(axis=0)
        inside = np.vstack([near > FAR, distance[taken][:, rest] <= np.minimum(near + 2 * eps, FAR + eps) + 1e-9])
        names = np.append(0, pivots[taken])
        cells = pd.DataFrame({"a": cls[rest], "b": pd.Series([None] * len(rest), dtype="Int64"), "cells": [names[x] for x in inside.T]})
        both = pd.concat([found[found["a"] != found["b"]].astype({"b": "Int64"}), cells], ignore_index=True)
        return both.assign(region=left["region"].iloc[0])

    return measure


def _linked(percent: int):
    """Links of a chunk's members with a block of pivots of other components."""

    def measure(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame([], columns=["a", "b"])
        if not len(left) or not len(right):
            return none
        left, right = left.drop_duplicates("cls"), right.drop_duplicates("cls")
        region = Region(_arrays(left["shingles"]) + _arrays(right["shingles"]), percent)
        region.root = np.concatenate([left["comp"], right["comp"]])
        cls, pivots, n, rows = left["cls"].to_numpy(), right["cls"].to_numpy(), len(left), []
        for p in range(len(right)):
            others = region.admitted(n + p, np.arange(n))
            if len(others):
                both = region.overlaps(n + p, others)
                hit = others[100 * both >= percent * (region.sizes[n + p] + region.sizes[others] - both)]
                rows.append(pd.DataFrame({"a": cls[hit], "b": pivots[p]}))
        return pd.concat(rows, ignore_index=True) if rows else none

    return measure


class _Join:
    """The Spark jobs of one join: regions that fit a task, Voronoi steps and rounds of pivots.

    ``sets`` (cls, shingles) and ``tokens`` (cls, token) are stored; members are (region, cls, n, fine).
    """

    def __init__(self, scratch: C.Scratch, percent: int, leaf: int, sets: DataFrame, tokens: DataFrame):
        self.scratch, self.percent, self.leaf, self.sets, self.tokens = scratch, percent, leaf, sets, tokens
        self.links: list[DataFrame] = []
        self.steps: Counter[str] = Counter()

    def with_sets(self, members: DataFrame) -> DataFrame:
        """With the shingles, under fresh attributes: two of these may meet in one job."""
        both = self.sets.join(members, "cls")
        return both.toDF(*both.columns)

    def small(self, members: DataFrame) -> None:
        """Regions that fit a task, each in one."""
        percent = self.percent

        def settle(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b, _ = region_links(pdf["cls"].to_numpy(), _arrays(pdf["shingles"]), percent)
            return pd.DataFrame({"a": a, "b": b})

        found = self.with_sets(members).groupBy("region").applyInPandas(settle, "a long, b long")
        self.links.append(self.scratch.table(found, "region-links"))

    def chunks(self, members: DataFrame) -> DataFrame:
        """Each region's number of rows and the number of chunks that it is dealt to."""
        size = members.groupBy("region").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("all"))
        return size.withColumn("chunks", F.ceil(F.greatest(F.col("all") / (self.leaf * 512), F.col("held") / self.leaf)))

    @staticmethod
    def chunk():
        return F.pmod(F.xxhash64("cls", F.lit(5)), F.col("chunks")).alias("chunk")

    @staticmethod
    def every_chunk():
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")

    @staticmethod
    def pivots(members: DataFrame, k: int, *order) -> DataFrame:
        """The first ``k`` members of each region with their number ``_r``, picked in salted parts first."""
        salted = W.partitionBy("region", F.pmod(F.xxhash64("cls", F.lit(3)), F.lit(64))).orderBy(*order, "cls")
        whole = W.partitionBy("region").orderBy(*order, "cls")
        some = members.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= k)
        return some.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= k)

    def run(self, members: DataFrame) -> None:
        """Settle all regions of ``members``, a stored table."""
        while True:
            rows = self.scratch.table(members.join(self.chunks(members), "region"), "sized")
            self.scratch.drop(members)
            self.small(rows.where("chunks <= 1").select("region", "cls"))
            large = rows.where("chunks > 1")
            if large.isEmpty():
                self.scratch.drop(rows)
                return
            self.steps["levels"] += 1
            chosen = self.pivots(large, JOB_PIVOTS, F.xxhash64("cls", F.lit(11))).select("region", "cls", self.every_chunk())
            chosen = self.with_sets(chosen).groupBy("region", "chunk")
            dealt = self.with_sets(large.select("region", "cls", self.chunk())).groupBy("region", "chunk")
            measured = dealt.cogroup(chosen).applyInPandas(_celled(self.percent), "region long, a long, b long, cells array<bigint>")
            measured = self.scratch.table(measured, "measured")
            self.links.append(self.scratch.table(measured.where("b is not null").select("a", "b"), "pivot-links"))
            # cells about as large as their region, or too many copies, are not joined recursively
            parent = large.select("region", "cls", "n", "fine", "held")
            inside = parent.join(measured.where("b is null").select("region", F.col("a").alias("cls"), "cells"), ["region", "cls"])
            crowded = inside.groupBy("region").agg((F.sum(F.size("cells")) > 2 * F.max("held")).alias("crowded"))
            cells = inside.join(crowded, "region").select(
                F.explode(F.when(F.col("crowded"), F.array(F.lit(1).cast("long"))).otherwise(F.col("cells"))).alias("pivot"), F.xxhash64("region", "pivot").alias("cell"), "cls", "n", "fine", "held",
            )
            cells = self.scratch.table(cells.withColumnRenamed("cell", "region"), "cells")
            size = cells.groupBy("region").agg(F.count(F.lit(1)).alias("now"), F.sum("n").alias("all"), F.max("held").alias("before"))
            self.steps["cells"] += size.count()
            stuck = size.where((F.col("now") > 0.5 * F.col("before")) & ((F.col("now") > self.leaf) | (F.col("all") > self.leaf * 512))).select("region")
            stays = cells.join(stuck, "region")
            following = cells.join(stuck, "region", "left_anti").select("region", "cls", "n", "fine").unionByName(self.parted(stays.where("pivot = 0 and not fine")))
            members = self.scratch.table(following, "members")
            rest = self.scratch.table(stays.where("pivot <> 0 or fine").select("region", "cls", "n"), "stuck-cells")
            self.scratch.drop(measured, cells, rows)
            self.exhaust(rest)

    def parted(self, far: DataFrame) -> DataFrame:
        """A cell of far ones as regions of members that share as many tokens as a link needs, directly or through others.

        Pairs are counted for tokens of at most ``HELD`` members; a member may share all of its
        tokens of more members with any other one, and those that could link by these alone are
        put together by token.
        """
        if far.isEmpty():
            return far.select("region", "cls", "n", F.lit(True).alias("fine"))
        self.steps["parted"] += 1
        held = self.scratch.table(far.select("region", "cls", "n").join(self.tokens, "cls"), "far-tokens")
        often = held.groupBy("region", "token").agg(F.count(F.lit(1)).alias("f"), F.min("cls").alias("lo"))
        hot = held.join(often.where(F.col("f") > HELD), ["region", "token"])
        of_hot = hot.groupBy("region", "cls").agg(F.count(F.lit(1)).alias("h"))
        group = held.join(often.where((F.col("f") > 1) & (F.col("f") <= HELD)).select("region", "token"), ["region", "token"])
        group = group.groupBy("region", "token").agg(F.sort_array(F.collect_list(F.struct("cls", "n"))).alias("g"))  # HELD at most
        pairs = group.select("region", F.explode(F.transform("g", lambda x, i: F.struct(x.alias("x"), F.slice("g", i + 2, HELD).alias("ys")))).alias("p"))
        pairs = pairs.select("region", F.col("p.x").alias("x"), F.explode("p.ys").alias("y")).select("region", F.col("x.cls").alias("a"), F.col("x.n").alias("na"), F.col("y.cls").alias("b"), F.col("y.n").alias("nb"))
        pairs = pairs.where(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb"))
        pairs = pairs.groupBy("region", "a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
        of_b = of_hot.select("region", F.col("cls").alias("b"), F.col("h").alias("hb"))
        pairs = pairs.join(of_hot.withColumnRenamed("cls", "a"), ["region", "a"], "left").join(of_b, ["region", "b"], "left").na.fill(0, ["h", "hb"])
        strong = pairs.where(F.col("c") + F.least("h", "hb") >= least_shared_column(F.least("na", "nb")))
        by_hot = hot.join(of_hot, ["region", "cls"]).where(F.col("h") >= least_shared_column(F.floor((self.percent * F.col("n") + 99) / 100)))
        node = lambda c: F.xxhash64("region", c)
        edges = strong.select(node("a").alias("a"), node("b").alias("b")).union(by_hot.where("cls <> lo").select(node("cls").alias("a"), node("lo").alias("b"))).distinct()
        parts = connected_components(self.scratch.table(edges, "far-edges"), self.scratch)
        rows = far.select("region", "cls", "n").withColumn("node", node("cls")).join(parts, "node")
        out = self.scratch.table(rows.select(F.col("component").alias("region"), "cls", "n", F.lit(True).alias("fine")), "parted")
        self.scratch.drop(held)
        return out

    def exhaust(self, left: DataFrame) -> None:
        """Rounds of pivots over cells that Voronoi steps don't make smaller; ``left`` is a stored table."""
        k = JOB_PIVOTS
        while not left.isEmpty():
            self.steps["rounds"] += 1
            comps = self.labels()
            rows = left.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
            many = rows.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("region")
            rows = rows.join(many, "region")
            rows = self.scratch.table(rows.join(self.chunks(rows), "region"), "unsettled")
            of_comp = rows.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("of_comp"))
            chosen = self.pivots(rows.select("region", "cls", "comp", "chunks").join(of_comp, ["region", "comp"]), k, "of_comp")
            chosen = self.scratch.table(chosen.select("region", "cls", "comp", "chunks", F.floor((F.col("_r") - 1) / 512).alias("block")), "round-pivots")
            dealt = rows.select("region", "cls", "comp", self.chunk()).join(chosen.select("region", "block").distinct(), "region")
            dealt = self.with_sets(dealt).groupBy("region", "chunk", "block")
            copies = self.with_sets(chosen.select("region", "cls", "comp", "block", self.every_chunk())).groupBy("region", "chunk", "block")
            found = dealt.cogroup(copies).applyInPandas(_linked(self.percent), "a long, b long")
            self.links.append(self.scratch.table(found, "round-links"))
            following = rows.select("region", "cls", "n").join(chosen.select("region", "cls"), ["region", "cls"], "left_anti")
            following = self.scratch.table(following, "stuck-cells")
            self.scratch.drop(left, rows, chosen, comps)
            left, k = following, k * 4
        self.scratch.drop(left)

    def labels(self) -> DataFrame:
        edges = self.links[0]
        for more in self.links[1:]:
            edges = edges.union(more)
        return connected_components(edges, self.scratch)


def _placed(docs: DataFrame, shingle: int, percent: int, key: str, text: str, buckets: int, leaf: int, broadcast_rows: int) -> DataFrame:
    """Per row of ``docs``: ``doc``, ``fp`` (of the text), ``n`` and ``component`` (a class; null for the empty set), stored."""
    spark = docs.sparkSession
    C.prepare(spark)
    scratch = C.Scratch(spark)
    kind = dict(docs.dtypes)[key]
    texts = docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(text).cast("string")).alias("fp"), F.col(text).cast("string").alias("text"))

    profiles = texts.mapInPandas(lambda it: _profiled(it, shingle, buckets), f"kind int, doc {kind}, fp long, n long, cls long, slice int, counts binary")
    profiles = scratch.table(profiles, "profiles", "kind")
    n_slices = max(1, buckets // SLICE)
    slices = profiles.where("kind = 1").select("slice", "counts").repartition(min(n_slices, 64), "slice")
    counts = np.zeros(buckets, dtype=np.uint32)  # fixed size, whatever the corpus
    for r in slices.mapInPandas(_summed, "slice int, counts binary").toLocalIterator():
        part = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.uint32)
        counts[r["slice"] * SLICE : r["slice"] * SLICE + len(part)] = part
    rarity = spark.sparkContext.broadcast(counts)
    rows = profiles.where("kind = 0").select("doc", "fp", "n", "cls")

    prefixes = texts.select("text").mapInPandas(lambda it: _prefixed(it, shingle, percent, rarity), "token long, cls long")
    prefixes = scratch.table(prefixes, "prefixes")
    by_token = prefixes.repartition("token")  # one shuffle serves the count, the join and the distinct
    shared = by_token.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("token")
    members = scratch.table(by_token.join(shared, "token").distinct(), "token-members")
    scratch.drop(prefixes)
    # a linked class shares at least as many tokens as the smaller of the two sets must; chance hits seldom do
    sizes = scratch.table(rows.where("cls is not null").groupBy("cls").agg(F.min("n").alias("n")), "class-sizes")
    needed = least_shared_column(F.floor((percent * F.col("n") + 99) / 100))
    for _ in range(2):
        enough = members.groupBy("cls").agg(F.count(F.lit(1)).alias("held")).join(sizes, "cls").where(F.col("held") >= needed).select("cls")
        left = members.select("token", "cls").join(enough, "cls")
        several = left.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("token", "lo")
        kept = scratch.table(left.join(several, "token"), "token-members")
        scratch.drop(members)
        members = kept
    # documents that share tokens, directly or through others, are one region, so each is in one region only
    edges = kept.where("cls <> lo").select(F.col("cls").alias("a"), F.col("lo").alias("b")).distinct()
    regions = connected_components(edges, scratch).select(F.col("node").alias("cls"), F.col("component").alias("region"))

    # one row of each class brings its set: that of smallest id, or where no row has an id those of one text
    wanted = regions.join(rows.where("cls is not null").groupBy("cls").agg(F.min("doc").alias("doc"), F.min("fp").alias("fp")), "cls")
    wanted = scratch.table(wanted.select("doc", F.when(F.col("doc").isNull(), F.col("fp")).alias("fp")).distinct(), "wanted-documents")
    held = texts.join(C.bounded_broadcast(wanted.select("doc").where("doc is not null"), broadcast_rows), "doc", "left_semi").select("text")
    nameless = wanted.where("doc is null").select("fp")

    def as_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [s for s in (_document_set(t, shingle) for t in pdf["text"]) if len(s)]
            yield pd.DataFrame({"cls": [_class_id(s) for s in sets], "shingles": [s.tobytes() for s in sets]}).astype({"cls": "int64"})

    found = held.mapInPandas(as_sets, "cls long, shingles binary")
    if not nameless.isEmpty():
        more = texts.where("doc is null").join(C.bounded_broadcast(nameless, broadcast_rows), "fp", "left_semi").select("text")
        found = found.unionByName(more.mapInPandas(as_sets, "cls long, shingles binary").dropDuplicates(["cls"]))
    sets = scratch.table(found, "sets")
    join = _Join(scratch, percent, leaf, sets, members.select("cls", "token"))
    join.run(scratch.table(regions.join(sizes, "cls").select("region", "cls", "n", F.lit(False).alias("fine")), "members"))
    labels = join.labels().withColumnRenamed("node", "cls")
    placed = scratch.table(rows.join(labels, "cls", "left").select("doc", "fp", "n", F.coalesce("component", "cls").alias("component")), "placed")
    scratch.drop(sets, members, sizes, regions, wanted, profiles, *join.links)
    return placed


def jaccard_components(
    docs: DataFrame, shingle: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text",
    buckets: int = 1 << 22, leaf: int = 4096, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles`` and ``component_id``, the smallest id reachable by
    links (100 * intersection >= ``percent`` * union of the shingle sets).

    A region of at most ``leaf`` documents, and 512 times as many shingles, is joined in one task.
    """
    placed = _placed(docs, shingle, percent, key, text, buckets, leaf, broadcast_rows)
    least = placed.where("component is not null").groupBy("component").agg(F.min("doc").alias("component_id"))
    return placed.join(least, "component", "left").select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"),
    )


def first_of_each(
    docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text",
    buckets: int = 1 << 22, leaf: int = 4096, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """``docs`` with one row of each component: that of smallest id (rows without id come last), then of
    smallest text fingerprint.  Rows with the empty set stay, and of rows that repeat id and text one stays."""
    placed = _placed(docs, shingle, percent, key, text, buckets, leaf, broadcast_rows)
    order = F.struct(F.col("doc").isNull().alias("late"), "doc", "fp")
    first = placed.where("component is not null").groupBy("component").agg(F.min(order).alias("first"))
    own = placed.join(first, "component").select("doc", "fp", (order != F.col("first")).alias("later"))
    marks = own.groupBy("doc", "fp").agg(F.min("later").alias("later"), (F.count(F.lit(1)) > 1).alias("repeated")).where("later or repeated")
    d, f, later, row = (C.fresh(docs, x) for x in ("_doc", "_fp", "_later", "_row"))
    marks = C.Scratch(docs.sparkSession).table(marks.select(F.col("doc").alias(d), F.col("fp").alias(f), F.col("later").alias(later)), "marks")
    marks = C.bounded_broadcast(marks, broadcast_rows)  # then no text is shuffled
    same = F.col(key).eqNullSafe(F.col(d)) & (F.xxhash64(F.col(text).cast("string")) == F.col(f))
    alone = docs.join(marks, same, "left_anti")
    repeats = docs.join(marks.where(~F.col(later)), same).withColumn(row, F.struct(*docs.columns))
    once = repeats.groupBy(d, f).agg(F.first(row).alias(row)).select(f"{row}.*")
    return alone.unionByName(once)
