"""Embedding near-dedup: spherical k-means cells, blocked cosines, one kept per group."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import drawn, long_id, ship_package, table
from gaugeworks.llm.graph import components
from gaugeworks.operators.joins import sized_join
from gaugeworks.session import settle

THRESHOLD = 0.98
#: Vectors the centroids are fitted on; all vectors are assigned and compared.
SAMPLE = 16_384
CELL_VECTORS = 2_048
MAX_CELLS = 1_024
#: Home vectors of one cell that are compared in one task.
BLOCK = 1_024
ROUNDS = 8
_SLACK = 1e-9


def spherical_kmeans(vectors: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors by cosine; begins with evenly spaced vectors."""
    cells = max(1, min(cells, len(vectors)))
    centres = vectors[np.linspace(0, len(vectors) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        nearest = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        length = np.linalg.norm(sums, axis=1)
        filled = length > 0
        centres[filled] = sums[filled] / length[filled, None]
    return centres


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest part first, against overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def cells_of(vectors: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and a mask of all cells it has to visit.

    A vector u that is linked to v lies within the chord sqrt(2 - 2 * threshold) of it. If
    u is at home with c, the plane between c and v's own centre h is at most that far from
    v. Every cell for which this holds is visited, so no link is lost.
    """
    products = vectors @ centres.T
    home = products.argmax(axis=1)
    gap = products[np.arange(len(vectors)), home][:, None] - products
    squared = np.maximum(0.0, 2.0 - 2.0 * (centres @ centres.T))
    reach = np.sqrt(max(0.0, 2.0 - 2.0 * threshold)) * np.sqrt(squared)[home]
    visited = gap <= reach + 1e-6
    visited[np.arange(len(vectors)), home] = True
    return home, visited


class _Block:
    """Home vectors of a block, compared with the candidates as they stream past."""

    def __init__(self, nodes: np.ndarray, vectors: np.ndarray, threshold: float) -> None:
        self.nodes, self.vectors, self.threshold = nodes, vectors, threshold
        self.links = np.zeros(len(nodes), np.int64)
        self.root = np.arange(len(nodes))

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(self.root, self.root[self.root]):
                self.root = self.root[self.root]

    def meet_own(self, start: int, end: int, copies: np.ndarray) -> None:
        """Count the links among the home vectors themselves, to those from start to end."""
        part = slice(start, end)
        place = np.arange(start, end)
        linked, homes = self.meet(self.nodes[part], copies[part], self.vectors[part])
        where = np.argsort(self.nodes[part])
        own = place[where][np.searchsorted(self.nodes[part][where], linked)]
        where = np.argsort(self.nodes)
        self._join(own, where[np.searchsorted(self.nodes[where], homes)])

    def meet(self, nodes: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count the links to these candidates; returns a link (candidate, home) of each linked."""
        linked = self.vectors @ vectors.T >= self.threshold - _SLACK
        home, other = np.nonzero(linked)
        exact = np.einsum("ij,ij->i", self.vectors[home], vectors[other]) >= self.threshold
        keep = exact & (self.nodes[home] != nodes[other])
        home, other = home[keep], other[keep]
        np.add.at(self.links, home, copies[other])
        order = np.lexsort((home, other))
        home, other = home[order], other[order]
        if not len(home):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        starts = np.flatnonzero(np.r_[True, other[1:] != other[:-1]])
        first = np.repeat(home[starts], np.diff(np.r_[starts, len(home)]))
        self._join(first, home)
        return nodes[other[starts]], self.nodes[home[starts]]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def fit_cells(classes: DataFrame, count: int, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Centroids for each length of vectors, fitted on a sample bounded by `sample`.

    The sample are the classes whose node hashes smallest; one task fits it.
    """
    cells = max(1, min(MAX_CELLS, count // CELL_VECTORS))

    def fit(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("node").to_numpy())
        vectors = unit(_matrix(group.column("vector").combine_chunks())[order])
        centres = spherical_kmeans(vectors, cells)
        return pa.table([pa.array(centres.tolist(), pa.list_(pa.float64()))], ["centre"])

    chosen = classes.where(drawn(sample / max(1, count), "node")).select("node", "vector", F.size("vector").alias("width"))
    rows = chosen.groupBy("width").applyInArrow(fit, "centre array<double>").collect()
    centres: dict[int, list[list[float]]] = {}
    for row in rows:
        centres.setdefault(len(row["centre"]), []).append(row["centre"])
    return {width: np.array(c) for width, c in centres.items()}


def vector_links(
    classes: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, block: int = BLOCK
) -> DataFrame:
    """Links among distinct vectors: rows (a, b, n_links).

    `classes` has node, label, vector (array<double>) and copies. For each node one row has
    its number of linked vectors, copies counted, and a link to another node of its
    component; further rows, with n_links null, link candidates to homes. All rows together
    connect every component. Cells of more than `block` home vectors are dealt to several
    tasks, each of which holds its share of homes and streams the cell's vectors past them,
    so no task holds a cell.
    """
    ship_package(classes.sparkSession)
    count = classes.count()
    centres = fit_cells(classes, count, sample)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.array([len(v) for v in batch.column(2)], np.int64)
            for width in np.unique(widths):
                part = batch.take(pa.array(np.flatnonzero(widths == width)))
                vectors = unit(_matrix(part.column(2)))
                own = centres.get(int(width))
                if own is None:
                    own = np.zeros((1, int(width)))
                home, visited = cells_of(vectors, own, threshold)
                row, cell = np.nonzero(visited)
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(taken), part.column(1).take(taken), part.column(3).take(taken),
                        pa.array(np.full(len(row), width, np.int32)), pa.array(cell.astype(np.int32)),
                        pa.array(home[row] == cell),
                        pa.FixedSizeListArray.from_arrays(pa.array(vectors[row].ravel()), int(width)).cast(pa.list_(pa.float64())),
                    ],
                    ["node", "label", "copies", "width", "cell", "at_home", "vector"],
                )

    label_type = classes.schema["label"].dataType.simpleString()
    members = classes.select("node", "label", "vector", "copies").mapInArrow(
        assign,
        f"node long, label {label_type}, copies long, width int, cell int, at_home boolean, vector array<double>",
    )
    members = settle(members)
    place = ["label", "width", "cell"]
    sizes = members.where("at_home").groupBy(*place).agg(
        F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")
    )
    members = sized_join(members, settle(sizes), place)
    members = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.withColumn("is_home", F.col("at_home") & (F.col("own") == F.col("block")))
    group = F.xxhash64(*place, "block")
    ordered = members.select(
        group.alias("part"), *place, "block", (~F.col("is_home")).alias("later"), "node", "copies", "vector", "is_home"
    ).repartition("part").sortWithinPartitions("part", *place, "block", "later", "node").select(
        *place, "block", "is_home", "node", "copies", "vector"
    )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, current = None, [], None

        def rows(a: np.ndarray, b: np.ndarray, n: np.ndarray | None) -> pa.RecordBatch:
            count = pa.nulls(len(a), pa.int64()) if n is None else pa.array(n, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), count], ["a", "b", "n_links"])

        def opened() -> _Block:
            nodes, copies, vectors = (np.concatenate(x) for x in zip(*homes, strict=True))
            made = _Block(nodes, vectors, threshold)
            for i in range(0, len(nodes), 512):
                made.meet_own(i, min(i + 512, len(nodes)), copies)
            return made

        def closed() -> Iterator[pa.RecordBatch]:
            if current is not None:
                yield rows(current.nodes, current.nodes[current.root], current.links)

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for start, end in zip(edges, edges[1:], strict=False):
                if start == end:
                    continue
                if keys[start] != key:
                    if current is None and homes:
                        current = opened()
                    yield from closed()
                    key, homes, current = keys[start], [], None
                part = batch.slice(start, end - start)
                is_home = part.column(4).to_numpy(zero_copy_only=False)
                nodes, copies = part.column(5).to_numpy(), part.column(6).to_numpy()
                vectors = _matrix(part.column(7))
                if is_home.any():
                    homes.append((nodes[is_home], copies[is_home], vectors[is_home]))
                if is_home.all():
                    continue
                if current is None:
                    if not homes:  # a block none of whose homes fell to it
                        continue
                    current = opened()
                others = ~is_home
                nodes, copies, vectors = nodes[others], copies[others], vectors[others]
                for i in range(0, len(nodes), 512):
                    a, b = current.meet(nodes[i : i + 512], copies[i : i + 512], vectors[i : i + 512])
                    if len(a):
                        yield rows(a, b, None)
        if current is None and homes:
            current = opened()
        yield from closed()

    return ordered.mapInArrow(compare, "a long, b long, n_links long")


def embedding_groups(
    df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
    threshold: float = THRESHOLD, sample: int = SAMPLE, block: int = BLOCK,
) -> DataFrame:
    """Near-duplicate vectors: id, n_links, component_id, kept; one row per input row.

    Two vectors of one label and length are linked if their cosine, in double precision, is
    at least `threshold`. component_id is the smallest id reachable, kept marks the row that
    has it. Equal vectors of a label are compared once, whatever their number, and linked
    with one another. Rows whose label or vector is null, or whose vector is empty, zero or
    has null or non-finite parts, link with nothing and stay by themselves. A null id is
    never the smallest: a component without any id has a null component_id, and kept is
    false there. Repeated rows count as separate vectors and share their result. An empty
    table gives an empty one. Other columns are left out.
    """
    own = df.select(
        long_id(df, id_column).alias("id"), F.col(f"`{label}`").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
    )
    largest = F.lit(1.7976931348623157e308)
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > largest))
    sound = F.coalesce(
        F.col("label").isNotNull() & ~odd & F.exists("vector", lambda x: x != 0.0), F.lit(False)
    )
    valid = own.where(sound)
    classes = valid.groupBy("label", "vector").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")
    ).withColumn("node", F.monotonically_increasing_id())
    classes = settle(classes)  # written once, so that its numbers stay
    found = settle(vector_links(classes, threshold, sample, block))
    grouped = settle(components(found, "a", "b"))
    counts = found.where("n_links is not null").select(F.col("a").alias("node"), "n_links")
    named = sized_join(classes.select("node", "least", "copies"), grouped, ["node"], "left")
    named = sized_join(named, counts, ["node"]).withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    result = sized_join(named, smallest, ["component"]).select(
        "node", (F.col("n_links") + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    result = settle(sized_join(classes.select("label", "vector", "node"), result, ["node"]).drop("node"))
    linked = sized_join(valid, result, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = own.where(~sound).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    )


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {"op3_embedding_near_dedup": op3_embedding_near_dedup}
ORACLE = {
    "op3_embedding_near_dedup": f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other
), counts AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
), parts AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM parts LEFT JOIN counts USING (vec_id)""",
}
