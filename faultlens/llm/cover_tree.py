"""Exact near-duplicate vectors by dual traversal of cover trees.

Equal vectors of a label are one class. Unit vectors of a label lie in a tree: its upper levels are split in Spark, each cell among sampled
centres, until a cell is small enough for a task; there a cover tree follows, nested levels of centres whose radii halve, each centre
being its own child and farther than the radius from the others. Pairs of nodes go down both trees together. A pair whose covering radii
keep all of its vectors apart is dropped, one whose radii keep all of them within the threshold links them all at once, and single vectors are
compared. So links are exact, a family of copies costs about as much as it has members, and no pair of it is written.
The trees of cells lie in files of the shared folder, which tasks memory-map.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultlens.llm.components import contract
from faultlens.llm.registry import query, table
from faultlens.llm.shared import map_array, new_folder, put_file, releasing, written

COSINE = 0.93
CELL_ROWS = 2048  # a larger cell is split
AIMED_ROWS = 1024  # of a cell after a split
FAN = 32  # centres of a split, at most
CHUNK_ROWS = 4096  # of a cell looked at together when it is split
LEAF = 16  # vectors of a tree's leaf
BLOCK = 512  # centres compared with others at once
SLACK = 1e-6  # far above the rounding of distances; vectors nearer to a bound than this are compared
CLOSE = 1e-9  # cosines this near to the threshold are computed from the vectors as given


def chords(cosines: np.ndarray) -> np.ndarray:
    """Distances of unit vectors from their products."""
    return np.sqrt(np.maximum(2.0 - 2.0 * cosines, 0.0))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled by powers of two, so that squares stay finite; their directions are unchanged."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0.0))
    return np.ldexp(vectors, -exponent[:, None])


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


# --- cover tree of a cell -------------------------------------------------------------------------------------------------------

@dataclass
class Tree:
    """Vectors in an order in which every node's are consecutive, and its nodes; node 0 is the root, children are consecutive."""

    vectors: np.ndarray
    ids: np.ndarray
    copies: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray  # first child, 0 for a leaf
    children: np.ndarray
    centre: np.ndarray  # place of the centre
    radius: np.ndarray  # largest distance of a vector below from the centre

    def __post_init__(self):
        self.unit = units(self.vectors)
        self.weight = np.concatenate([[0], np.cumsum(self.copies)])

    def below(self, node: int) -> slice:
        return slice(int(self.begin[node]), int(self.end[node]))

    def weights(self, nodes: np.ndarray) -> np.ndarray:
        return self.weight[self.end[nodes]] - self.weight[self.begin[nodes]]

    def parts(self, node: int) -> np.ndarray:
        """Children, or of a leaf the node itself."""
        return np.arange(self.child[node], self.child[node] + self.children[node]) if self.children[node] else np.array([node])

    _ARRAYS = (("ids", "<i8"), ("copies", "<i8"), ("begin", "<i8"), ("end", "<i8"), ("child", "<i8"), ("children", "<i8"), ("centre", "<i8"), ("radius", "<f8"))

    def chunks(self) -> Iterator[np.ndarray]:
        yield np.ascontiguousarray(self.vectors, "<f8")
        for name, kind in self._ARRAYS:
            yield np.ascontiguousarray(getattr(self, name), kind)

    @classmethod
    def read(cls, file: str, offset: int, rows: int, dimension: int, nodes: int) -> Tree:
        data = map_array(file, "<f8", offset, rows * dimension + 2 * rows + 6 * nodes)
        vectors, rest = data[:rows * dimension].reshape(rows, dimension), data[rows * dimension:]
        out, at = {}, 0
        for name, kind in cls._ARRAYS:
            size = rows if name in ("ids", "copies") else nodes
            out[name] = np.array(rest[at:at + size]).view(kind)
            at += size
        return cls(np.array(vectors), **out)


def cover_tree(vectors: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> Tree:
    """The cover tree of some vectors (not zero)."""
    unit = units(vectors)
    order = np.arange(len(unit))
    begin, end, child, children, centre, radius = [0], [len(unit)], [0], [0], [0], [0.0]
    far = chords(unit @ unit[0]) if len(unit) else np.empty(0)
    waiting = [(0, order, far, 2.0)]
    while waiting:
        node, members, far, level = waiting.pop()
        order[begin[node]:end[node]] = members  # its centre comes first
        centre[node], radius[node] = begin[node], float(far.max(initial=0.0)) if len(members) > 1 else 0.0
        if len(members) <= LEAF or radius[node] <= SLACK:
            continue
        while level >= radius[node]:
            level /= 2
        # Centres farther apart than the level's radius, the node's own centre first.
        groups, left, distance = [], members, far
        while len(left):
            near = distance <= level
            near[0] = True
            groups.append((left[near], distance[near]))
            left = left[~near]
            if len(left):
                distance = chords(unit[left] @ unit[left[0]])
        child[node], children[node] = len(begin), len(groups)
        at = begin[node]
        for group, distance in groups:
            waiting.append((len(begin), group, distance, level))
            for values, value in ((begin, at), (end, at + len(group)), (child, 0), (children, 0), (centre, at), (radius, 0.0)):
                values.append(value)
            at += len(group)
    return Tree(vectors[order], ids[order], copies[order], *(np.array(x, np.int64) for x in (begin, end, child, children, centre)), np.array(radius))


class Links:
    """Links between the vectors of two trees, or within one: of each vector their number, and what they join."""

    def __init__(self, left: Tree, right: Tree, cosine: float, keep: bool = False):
        self.left, self.right, self.same = left, right, left is right
        self.cosine, self.reach = cosine, float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine)))
        self.counts = np.zeros(len(left.ids), np.int64), np.zeros(0 if self.same else len(right.ids), np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0
        self.label = np.arange(len(left.ids) + len(self.counts[1]))
        self.found: list[tuple[np.ndarray, np.ndarray]] | None = [] if keep else None
        self._descend()
        self._join()

    def _of_right(self) -> tuple[np.ndarray, int]:
        return (self.counts[0], 0) if self.same else (self.counts[1], len(self.left.ids))

    def linked(self, i: np.ndarray, j: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """Which pairs of vectors (places) link; those close to the threshold by their vectors as given."""
        out = cosines >= self.cosine
        for at in np.flatnonzero(np.abs(cosines - self.cosine) <= CLOSE):
            x, y = self.left.vectors[i[at]], self.right.vectors[j[at]]
            out[at] = float(x @ y) / (float(np.sqrt(x @ x)) * float(np.sqrt(y @ y))) >= self.cosine
        return out

    def _add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Links between vectors at these places."""
        if not len(i):
            return
        counts, shift = self._of_right()
        np.add.at(self.counts[0], i, self.right.copies[j])
        np.add.at(counts, j, self.left.copies[i])
        self._edge(i, j + shift)
        if self.found is not None:
            self.found.append((i, j))

    def _edge(self, i: np.ndarray, j: np.ndarray) -> None:
        self.edges.append((i, j))
        self.held += len(i)
        if self.held > 1_000_000:
            self._join()

    def _join(self) -> None:
        """Labels of joined vectors: the smallest place of each."""
        if self.edges:
            a, b = (np.concatenate([edge[side] for edge in self.edges]) for side in (0, 1))
            self.edges, self.held = [], 0
            while True:
                low, high = self.label[a], self.label[b]
                apart = low != high
                if not apart.any():
                    break
                a, b, low, high = a[apart], b[apart], low[apart], high[apart]
                np.minimum.at(self.label, np.maximum(low, high), np.minimum(low, high))
                while True:
                    jumped = self.label[self.label]
                    if (jumped == self.label).all():
                        break
                    self.label = jumped

    def _all(self, a: int, b: int) -> None:
        """Every vector below one node links with every one below the other (or with the others below the same)."""
        counts, shift = self._of_right()
        own, its = self.left.below(a), self.right.below(b)
        if self.same and a == b:
            weight = int(self.left.weight[own.stop] - self.left.weight[own.start])
            self.counts[0][own] += weight - self.left.copies[own]
        else:
            self.counts[0][own] += int(self.right.weight[its.stop] - self.right.weight[its.start])
            counts[its] += int(self.left.weight[own.stop] - self.left.weight[own.start])
        i, j = np.arange(own.start, own.stop), np.arange(its.start, its.stop)
        self._edge(i, np.full(len(i), its.start + shift))
        self._edge(np.full(len(j), own.start), j + shift)
        if self.found is not None:
            x, y = (grid.ravel() for grid in np.meshgrid(i, j, indexing="ij"))
            some = x < y if self.same and a == b else slice(None)
            self.found.append((x[some], y[some]))

    def _descend(self) -> None:
        left, right = self.left, self.right
        if not len(left.ids) or not len(right.ids):
            return
        waiting = [(0, 0)]
        while waiting:
            a, b = waiting.pop()
            itself = self.same and a == b
            if itself and 2 * left.radius[a] <= self.reach - SLACK:
                self._all(a, a)
                continue
            if not left.children[a] and not right.children[b]:
                own, its = left.below(a), right.below(b)
                cosines = left.unit[own] @ right.unit[its].T
                i, j = np.nonzero(np.triu(cosines >= self.cosine - CLOSE, 1) if itself else cosines >= self.cosine - CLOSE)
                sure = self.linked(i + own.start, j + its.start, cosines[i, j])
                self._add(i[sure] + own.start, j[sure] + its.start)
                continue
            parts, others = left.parts(a), right.parts(b)
            if itself:
                waiting += [(int(node), int(node)) for node in parts if left.end[node] - left.begin[node] > 1]
            many = right.end[others] - right.begin[others]
            for begun in range(0, len(parts), BLOCK):
                some = parts[begun:begun + BLOCK]
                cosines = left.unit[left.centre[some]] @ right.unit[right.centre[others]].T
                apart = chords(cosines)
                radii = left.radius[some][:, None] + right.radius[others]
                open_ = apart - radii <= self.reach + SLACK
                if itself:
                    open_ &= some[:, None] < others
                i, j = np.nonzero(open_)
                one = (left.end[some[i]] - left.begin[some[i]] == 1) & (many[j] == 1)
                x, y = left.centre[some[i[one]]], right.centre[others[j[one]]]
                sure = self.linked(x, y, cosines[i[one], j[one]])
                self._add(x[sure], y[sure])
                i, j = i[~one], j[~one]
                whole = apart[i, j] + radii[i, j] <= self.reach - SLACK
                for u, v in zip(some[i[whole]].tolist(), others[j[whole]].tolist(), strict=True):
                    self._all(u, v)
                waiting += zip(some[i[~whole]].tolist(), others[j[~whole]].tolist(), strict=True)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the vectors with links: number of the class, links, number of a class it is joined with."""
        ids = self.left.ids if self.same else np.concatenate([self.left.ids, self.right.ids])
        counts = self.counts[0] if self.same else np.concatenate(self.counts)
        some = np.flatnonzero(counts)
        return ids[some], counts[some], ids[self.label[some]]


# --- upper levels, split in Spark -------------------------------------------------------------------------------------------------

def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _split(group: pa.Table) -> pa.Table:
    """Rows ``cell, chunk, node, copies, v, place``: vectors (null place) and centres; each vector goes to its nearest centre."""
    place = group.column("place").combine_chunks()
    centres, points = group.filter(place.is_valid()), group.filter(place.is_null())
    vectors = units(scaled(_matrix(points.column("v").combine_chunks())))
    cosines = vectors @ units(scaled(_matrix(centres.column("v").combine_chunks()))).T
    best = cosines.max(axis=1, initial=-1.0)
    # Vectors as near to several centres are dealt out over them, so a cell of one direction is split too.
    tied = cosines >= best[:, None] - 1e-14
    nodes = points.column("node").to_numpy()
    turn = (nodes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % np.maximum(1, tied.sum(axis=1))
    chosen = (np.cumsum(tied, axis=1) - 1 == turn[:, None]) & tied
    own = chosen.argmax(axis=1)
    return pa.table({
        "parent": points.column("cell"), "node": points.column("node"), "copies": points.column("copies"), "v": points.column("v"),
        "centre": centres.column("node").combine_chunks().take(pa.array(own)), "far": pa.array(chords(cosines[np.arange(len(own)), own]))})


def _bounds(reach: float):
    """Rows ``a, b, x, y, radii, same``: may vectors below the nodes lie within reach, and do all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, x, y, radii, same = batch.columns
            verdict = np.empty(batch.num_rows, np.int32)
            radii, same = radii.to_numpy(), same.to_numpy(zero_copy_only=False)
            sizes = x.value_lengths().to_numpy()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                left, right = (units(scaled(_matrix(column.take(pa.array(rows))))) for column in (x, y))
                apart = np.where(same[rows], 0.0, chords((left * right).sum(axis=1)))
                verdict[rows] = np.where(apart - radii[rows] > reach + SLACK, 0, np.where(apart + radii[rows] <= reach - SLACK, 2, 1))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(verdict)], names=["a", "b", "verdict"])

    return run


@dataclass
class Cells:
    """The upper tree: ``points`` (``node, copies, cell, v``) of its leaves, and ``cells`` (``cell, parent, leaf, radius, weight, node, v``)."""

    points: DataFrame
    cells: DataFrame


def _type_of(points: DataFrame) -> str:
    return dict(points.dtypes)["v"]


def grow_cells(points: DataFrame) -> Cells:
    """The upper tree over ``points`` (``node, copies, cell, v``), whose cells are those of the roots."""
    kind = _type_of(points)
    one = W.partitionBy("cell").orderBy(F.xxhash64("node", F.lit(0)), "node")
    tops = points.select("cell", "node", "v", F.row_number().over(one).alias("at")).where("at = 1").drop("at")
    sizes = points.groupBy("cell").agg(F.count("*").alias("rows"), F.sum("copies").alias("weight"), F.lit(2.0).alias("radius"))
    known = [written(sizes.join(tops, "cell").select("cell", F.lit(None).cast("long").alias("parent"), (F.col("rows") <= CELL_ROWS).alias("leaf"), "radius", "rows", "weight", "node", "v"), "cells")]
    done = []
    depth = 0
    while True:
        depth += 1
        large = known[-1].where("NOT leaf").select("cell", "rows")
        if large.isEmpty():
            done.append(points)
            break
        fan = F.least(F.lit(FAN), F.ceil(F.col("rows") / AIMED_ROWS)).cast("int")
        open_ = points.join(large, "cell")
        first = W.partitionBy("cell").orderBy(F.xxhash64("node", F.lit(depth)), "node")
        # Rows of a split share the cell, so sampled centres of a cell are few and chosen before the shuffle.
        centres = open_.select("cell", "node", "v", "rows", F.row_number().over(first).alias("place")).where(F.col("place") <= FAN).where(F.col("place") <= F.greatest(F.lit(2), fan))
        chunks = F.ceil(F.col("rows") / CHUNK_ROWS).cast("long")
        dealt = open_.select("cell", F.pmod(F.xxhash64("node", F.lit(-depth)), chunks).alias("chunk"), "node", "copies", "v", F.lit(None).cast("int").alias("place")).unionByName(
            centres.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"), "node", F.lit(0).cast("long").alias("copies"), "v", "place"))
        moved = written(dealt.groupBy("cell", "chunk").applyInArrow(_split, f"parent long, node long, copies long, v {kind}, centre long, far double").withColumn(
            "cell", F.xxhash64("parent", "centre", F.lit(depth))), "split")
        sizes = moved.groupBy("cell", "parent", "centre").agg(F.count("*").alias("rows"), F.sum("copies").alias("weight"), F.max("far").alias("radius"))
        vectors = centres.select(F.col("cell").alias("parent"), F.col("node").alias("centre"), "v")
        known.append(written(sizes.join(vectors, ["parent", "centre"]).select(
            "cell", "parent", (F.col("rows") <= CELL_ROWS).alias("leaf"), "radius", "rows", "weight", F.col("centre").alias("node"), "v"), "cells"))
        done.append(points.join(large, "cell", "left_anti"))
        points = moved.select("node", "copies", "cell", "v")
    cells, leaves = known[0], done[0]
    for more in known[1:]:
        cells = cells.unionByName(more)
    for more in done[1:]:
        leaves = leaves.unionByName(more)
    return Cells(leaves, cells)


def _cell_pairs(cells: DataFrame, reach: float, whole: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs of leaf cells to be compared, and (where ``whole``) pairs of cells all of whose vectors link. Both trees are gone down together."""
    spark = cells.sparkSession
    kids = cells.where("parent IS NOT NULL").select("parent", "cell").unionByName(cells.where("leaf").select(F.col("cell").alias("parent"), "cell"))
    leaves = cells.where("leaf").select("cell")
    pairs = cells.where("parent IS NULL").select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    empty = spark.createDataFrame([], "a long, b long")
    compared, joined = empty, empty
    side = cells.select("cell", "radius", "v")
    while True:
        bounded = written(
            pairs.join(side.withColumnsRenamed({"cell": "a", "radius": "p", "v": "x"}), "a").join(side.withColumnsRenamed({"cell": "b", "radius": "q", "v": "y"}), "b")
            .select("a", "b", "x", "y", (F.col("p") + F.col("q")).alias("radii"), (F.col("a") == F.col("b")).alias("same")).mapInArrow(releasing(_bounds(reach)), "a long, b long, verdict int"), "pairs")
        open_ = bounded.where("verdict = 1" if whole else "verdict >= 1").select("a", "b")
        if whole:
            joined = joined.unionByName(bounded.where("verdict = 2").select("a", "b"))
        ends = open_.join(leaves.withColumnRenamed("cell", "a"), "a", "left_semi").join(leaves.withColumnRenamed("cell", "b"), "b", "left_semi")
        compared = compared.unionByName(ends)
        deeper = open_.join(ends, ["a", "b"], "left_anti")
        if deeper.isEmpty():
            return compared, joined
        left, right = kids.withColumnsRenamed({"parent": "a", "cell": "c"}), kids.withColumnsRenamed({"parent": "b", "cell": "d"})
        pairs = deeper.join(left, "a").join(right, "b").where("a <> b OR c <= d").select(F.col("c").alias("a"), F.col("d").alias("b"))


# --- trees of cells and their comparison ------------------------------------------------------------------------------------------

_PLACES = "cell long, file string, offset long, rows int, dimension int, nodes int"


def _tree_writer(folder: str):
    """Writes the trees of a partition's cells (rows ``cell, node, copies, v`` sorted by cell) as one file; where each lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"{folder}/trees-{TaskContext.get().partitionId():06d}.bin"
        places = []

        def cells():
            held: list[pa.RecordBatch] = []
            for batch in batches:
                number = batch.column(0).to_numpy()
                cuts = np.flatnonzero(np.diff(number)) + 1
                for begun, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(number)], strict=True):
                    if held and begun < end and held[0].column(0)[0].as_py() != int(number[begun]):
                        yield pa.Table.from_batches(held)
                        held = []
                    if begun < end:
                        held.append(batch.slice(begun, end - begun))
            if held:
                yield pa.Table.from_batches(held)

        def chunks():
            offset = 0
            for cell in cells():
                vectors = scaled(_matrix(cell.column("v").combine_chunks()))
                tree = cover_tree(vectors, cell.column("node").to_numpy(), cell.column("copies").to_numpy())
                places.append((cell.column("cell")[0].as_py(), name, offset, *vectors.shape, len(tree.begin)))
                for chunk in tree.chunks():
                    offset += chunk.nbytes
                    yield chunk

        put_file(name, chunks())
        if places:
            columns = list(zip(*places, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)],
                names=["cell", "file", "offset", "rows", "dimension", "nodes"])

    return run


def _compare(cosine: float, keep: bool):
    """Rows with the places of two cells' trees, sorted by the first: links of their vectors, or (``keep``) linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                own, its = row[:5], row[5:]
                if own != last:
                    last, left = own, Tree.read(*own)
                right = left if its == own else Tree.read(*its)
                links = Links(left, right, cosine, keep)
                if keep:
                    for i, j in links.found:
                        for begun in range(0, len(i), 10_000):
                            x, y = i[begun:begun + 10_000], j[begun:begun + 10_000]
                            cosines = (left.unit[x] * right.unit[y]).sum(axis=1)
                            yield pa.RecordBatch.from_arrays([pa.array(left.ids[x]), pa.array(right.ids[y]), pa.array(cosines)], names=["a", "b", "cosine"])
                else:
                    ids, counts, others = links.rows()
                    if len(ids):
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts), pa.array(others)], names=["node", "links", "other"])

    return run


_PLACE = ["file", "offset", "rows", "dimension", "nodes"]


def _compared(upper: Cells, pairs: DataFrame, cosine: float, keep: bool) -> DataFrame:
    spark = pairs.sparkSession
    folder = new_folder(spark, "trees")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    needed = max(parts, upper.cells.where("leaf").count() // 8)
    kind = ["cell", "node", "copies", "v"]
    places = written(upper.points.select(*kind).repartition(needed, "cell").sortWithinPartitions("cell", "node").mapInArrow(releasing(_tree_writer(folder)), _PLACES), "places")
    own, its = ([F.col(c).alias(f"{side}_{c}") for c in _PLACE] for side in ("own", "its"))
    work = pairs.join(places.select(F.col("cell").alias("a"), *own), "a").join(places.select(F.col("cell").alias("b"), *its), "b")
    work = written(work, "work")
    # Pairs are dealt out evenly; those of a cell that come to one task read its tree once.
    dealt = work.repartition(max(parts, work.count() // 64), "a", "b").sortWithinPartitions("a", "b").drop("a", "b")
    return dealt.mapInArrow(releasing(_compare(cosine, keep)), "a long, b long, cosine double" if keep else "node long, links long, other long")


def _classes(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """Rows with the number of their class, null for rows that take no part."""
    finite = F.col("v").isNotNull() & F.exists("v", lambda c: c != 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    takes_part = F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    return rows.withColumn("node", F.when(takes_part, F.xxhash64("label", "v")))


def _points(rows: DataFrame) -> DataFrame:
    """One row a class: ``node, copies, low`` (smallest number), ``cell`` (its label's root) and ``v``."""
    return written(rows.where("node IS NOT NULL").groupBy("node").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("low"), F.first(F.xxhash64("label", F.size("v"))).alias("cell"), F.first("v").alias("v")), "classes")


def threshold_pairs(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_a, vec_b, cosine``: linked pairs of different vectors of a label, each vector by its smallest number.

    Rows are read as in ``near_duplicate_vectors``; vectors whose rows have no number have null. Equal rows are one vector and no pair. Families
    of nearly equal vectors make many pairs: only ``near_duplicate_vectors`` counts them without writing them.
    """
    classes = _points(_classes(vectors, vec_id, vector, label))
    upper = grow_cells(classes.drop("low"))
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine)))
    compared, _ = _cell_pairs(upper.cells, reach, whole=False)
    found = _compared(upper, compared, cosine, keep=True)
    low = classes.select("node", "low")
    named = found.join(low.withColumnsRenamed({"node": "a", "low": "x"}), "a").join(low.withColumnsRenamed({"node": "b", "low": "y"}), "b")
    return named.select(F.least("x", "y").alias("vec_a"), F.greatest("x", "y").alias("vec_b"), "cosine")


def _ancestors(cells: DataFrame) -> DataFrame:
    """``cell, above`` for every leaf and each cell on its way up, itself included."""
    up = cells.select(F.col("cell").alias("above"), "parent")
    reached = cells.where("leaf").select("cell", F.col("cell").alias("above"))
    out = reached
    while True:
        reached = written(reached.join(up, "above").where("parent IS NOT NULL").select("cell", F.col("parent").alias("above")), "above")
        if reached.isEmpty():
            return out
        out = out.unionByName(reached)


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors``.

    Rows link when their labels are equal and not null and the cosine of their vectors, in double precision, is at least ``cosine`` (above 0);
    ``n_links`` counts the other rows linked directly, equal ones too, ``component_id`` is the smallest number reachable by links and
    ``kept`` tells whether it is the row's own. Null, empty and zero vectors, those with a null or non-finite entry and those without label
    link with nothing; vectors of different lengths don't link. Repeated rows link with each other; a null number leaves the component's
    number to the others (null, and ``kept`` null, if it is alone). Vectors of any length of list are compared whole; an empty table gives no
    rows; further columns of any name are left out. Equal vectors are told by 64-bit hashes.
    """
    rows = _classes(vectors, vec_id, vector, label)
    classes = _points(rows)
    upper = grow_cells(classes.drop("low"))
    cells = upper.cells
    compared, joined = _cell_pairs(cells, float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine))), whole=True)
    found = written(_compared(upper, compared, cosine, keep=False), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    joined = written(joined, "joined")
    if not joined.isEmpty():
        # Cells that link as a whole: what each adds to the vectors below it, and a vector by which they are joined.
        weight = cells.select("cell", "weight", "node")
        both = joined.unionByName(joined.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        added = both.join(weight.select(F.col("cell").alias("b"), "weight"), "b").groupBy(F.col("a").alias("above")).agg(
            F.sum("weight").alias("more"), F.max((F.col("a") == F.col("b")).cast("long")).alias("itself"))
        below = written(_ancestors(cells).join(added, "above").join(weight.select(F.col("cell").alias("above"), F.col("node").alias("centre")), "above"), "below")
        point = upper.points.select("node", "copies", "cell").join(below, "cell")
        links = links.unionByName(point.select("node", (F.col("more") - F.col("itself") * F.col("copies")).alias("links"))).groupBy("node").agg(F.sum("links").alias("links"))
        centre = weight.select("cell", "node")
        edges = edges.unionByName(point.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))).unionByName(
            joined.where("a <> b").join(centre.withColumnsRenamed({"cell": "a", "node": "x"}), "a").join(centre.withColumnsRenamed({"cell": "b", "node": "y"}), "b").where("x <> y")
            .select(F.col("x").alias("a"), F.col("y").alias("b")))
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    labels = contract(written(ends.select("node", F.col("node").alias("comp")), "labels"), edges)
    least = labels.join(classes.select("node", "low"), "node").groupBy("comp").agg(F.min("low").alias("component_id"))
    known = written(
        classes.select("node", "copies", "low").join(labels, "node", "left").join(least, "comp", "left").join(links, "node", "left")
        .select("node", (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"), F.when(F.col("comp").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id")), "known")
    return rows.select("vec_id", "node").join(known, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))


SQL = """
WITH usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  WITH RECURSIVE r(vec_id, to_) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, links.y FROM r JOIN links ON links.x = r.to_)
  SELECT vec_id, min(to_) AS component_id FROM r GROUP BY vec_id),
counted AS (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN reach USING (vec_id) LEFT JOIN counted ON counted.vec_id = e.vec_id
"""


@query("op12_embedding_near_dedup", SQL)
def op12_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))
