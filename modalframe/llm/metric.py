"""Embedding near-duplicates: an exact metric range join over pivot cells.

Vectors are scaled to unit length, where cosine >= c means Euclidean distance <= r = sqrt(2 - 2c). Equal vectors collapse before any join, with
their count. Pivots split the space: a vector's home is the cell of its nearest pivot, and by the triangle inequality a vector at
distances a (home pivot) and b (another pivot) can only reach into the other cell if b - a <= 2r, so it is compared with the vectors
at home there only then.

Cells are packed into stripes of bounded size, a cell with many vectors is dealt to several. One scan a stripe compares its residents with the vectors of
this stripe and all later ones, so a pair in two stripes meets once. The residents pass through the driver, a stripe at a time; vectors are not
copied or shuffled for the comparison, so neither disk nor the memory of a task grows with the number of cells or stripes.
A task reports counts and, for the groups, one edge a vector; links are never listed. The decision itself is the cosine in double
precision of the stored components, so rounding of the prefilter cannot change it.

Defined results: a vector that is null, zero, or has a null, NaN or infinite component links with nothing and is its own component. Vectors
of different lengths never link. A null vec_id gets n_links and a null component and kept; it can bridge other vectors. Repeated rows (same
id and vector) are rows of their own: they link with each other.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UnionFind, bounded_rows, components, shared_dir, store

TILE = 8192  # vectors of a cell aimed at; a stripe holds four times as many residents
STRIPE = 2_097_152  # components of the residents of a stripe
SLICE, ACROSS = 1024, 2048  # rows compared with columns at a time
SLACK = 1e-6  # widens the replication against rounding
MARGIN = 1e-4  # widens the prefilter against rounding of dot products in single precision


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which is exact, so that no square over- or underflows."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1, keepdims=True))[1])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of row pairs in double precision."""
    a, b = _scaled(a), _scaled(b)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = _scaled(rows)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def distinct_vectors(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, key) and (vectors: key, v, n, least); key is null for vectors that link with nothing."""
    v = F.col(vector_col).cast("array<double>")
    bad = v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    # -0.0 and 0.0 are one value
    clean = F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    named = table.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(bad, F.lit(True)), None).otherwise(clean).alias("v"))
    if dict(table.dtypes)[vector_col] == "array<float>":
        named = named.withColumn("v", F.col("v").cast("array<float>"))  # half the bytes, the same numbers
    rows = store(named.select("vec_id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("key")), "vectors")
    vectors = rows.where("key is not null").groupBy("key", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    return rows, vectors


def choose_pivots(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """For each dimension at most `n` unit pivots: spread-out picks (farthest first) from a bounded hash sample of `4 n` distinct vectors."""
    sample = bounded_rows(vectors.select("v"), F.col("v"), 4 * n).collect()
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r.v), []).append(r.v)
    pivots = {}
    for size, rows in by_size.items():
        unit = _unit(np.array(rows, np.float64))
        picks, far = [0], np.linalg.norm(unit - unit[0], axis=1)
        while len(picks) < min(n, len(unit)) and far.max() > 1e-9:
            picks.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(unit - unit[picks[-1]], axis=1))
        pivots[size] = unit[picks]
    return pivots


class Rows:
    """Vectors in double and, scaled to unit length, single precision, with their node numbers and multiplicities."""

    def __init__(self, nodes: np.ndarray, vectors: np.ndarray, times: np.ndarray, unit: np.ndarray | None = None) -> None:
        self.nodes, self.vectors, self.times = nodes, vectors, times
        self.unit = (_unit(vectors) if unit is None else unit).astype(np.float32)

    def at(self, spots: np.ndarray) -> Rows:
        return self if len(spots) == len(self.nodes) else Rows(self.nodes[spots], self.vectors[spots], self.times[spots], self.unit[spots])


def _links(own: Rows, others: Rows, cosine: float):
    """Linked pairs as places `(i, j)`, `i` rising, of at most SLICE rows with ACROSS columns at a time.

    Single precision only discards pairs; whatever is not clearly below the threshold is decided in double precision.
    """
    for at in range(0, len(own.nodes), SLICE):
        for to in range(0, len(others.nodes), ACROSS):
            dots = own.unit[at : at + SLICE] @ others.unit[to : to + ACROSS].T
            found = np.flatnonzero(dots >= np.float32(cosine - MARGIN))
            if not len(found):
                continue
            close = np.flatnonzero(dots.ravel()[found] < np.float32(cosine + MARGIN))
            i, j = np.divmod(found, dots.shape[1])
            keep = np.ones(len(i), bool)
            for k in range(0, len(close), 16_384):
                part = close[k : k + 16_384]
                keep[part] = cosines(own.vectors[at + i[part]], others.vectors[to + j[part]]) >= cosine
            if not keep.all():
                i, j = i[keep], j[keep]
            if len(i):
                i += at
                j += to
                yield i, j


def cells_of(unit: np.ndarray, centre: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of each unit vector, whether it can reach into each cell)."""
    square = np.maximum(0, 1 + (centre * centre).sum(1) - 2 * unit @ centre.T)
    near, home = np.sqrt(square), square.argmin(1)
    reach = near <= near.min(1, keepdims=True) + 2 * radius + SLACK
    # the same inequality along the line through two pivots: distance to the plane between their cells
    own = (centre * centre).sum(1)
    apart = np.sqrt(np.maximum(0, own[:, None] + own - 2 * centre @ centre.T))[home]
    reach &= square - square.min(1, keepdims=True) <= 2 * radius * apart + SLACK
    return home, reach


def _slices(batches, pivots: dict[int, np.ndarray], radius: float):
    """(size, rows of a batch, their vectors, unit vectors, home cells, reach), at most SLICE rows at a time, all of one size."""
    for batch in batches:
        sizes = batch["v"].map(len).to_numpy()
        for size in np.unique(sizes).tolist():
            part, centre = batch[sizes == size], pivots.get(size, np.zeros((1, size)))
            for at in range(0, len(part), SLICE):
                some = part.iloc[at : at + SLICE]
                rows = np.concatenate(some["v"].to_list()).astype(np.float64).reshape(-1, size)
                unit = _unit(rows)
                yield size, some, rows, unit, *cells_of(unit, centre, radius)


def cell_counts(vectors: DataFrame, pivots: dict[int, np.ndarray], radius: float) -> dict[tuple[int, int], int]:
    """Vectors at home in each (size, cell)."""

    def run(batches):
        for size, _, _, _, home, _ in _slices(batches, pivots, radius):
            cells, found = np.unique(home, return_counts=True)
            yield pd.DataFrame({"size": size, "cell": cells, "n": found})

    rows = vectors.select("v").mapInPandas(run, "size int, cell int, n long").groupBy("size", "cell").agg(F.sum("n").alias("n")).collect()
    return {(r["size"], r["cell"]): r["n"] for r in rows}


def plan_stripes(counts: dict[tuple[int, int], int], tile: int) -> tuple[dict[tuple[int, int], tuple[int, int]], int]:
    """((first stripe, number of stripes) of each cell, stripes in all): at most `4 tile` vectors and `STRIPE` components a stripe."""
    plan, at, free = {}, -1, 0.0
    for (size, cell), n in sorted(counts.items()):
        share = n / max(1, min(4 * tile, STRIPE // size))  # of a stripe
        if share > 1:
            plan[size, cell] = (at + 1, math.ceil(share))
            at, free = at + math.ceil(share), 0.0
        else:
            if share > free:
                at, free = at + 1, 1.0
            plan[size, cell] = (at, 1)
            free -= share
    return plan, at + 1


def _stripes_of(size: int, home: np.ndarray, nodes: np.ndarray, plan: dict[tuple[int, int], tuple[int, int]]) -> np.ndarray:
    cells, code = np.unique(home, return_inverse=True)
    first, parts = np.array([plan[size, c] for c in cells.tolist()]).T
    return first[code] + (nodes * 0x9E3779B1 % 0x7FFFFFFF) % parts[code]


def stripe_of(vectors: DataFrame, stripe: int, pivots: dict[int, np.ndarray], radius: float, plan: dict[tuple[int, int], tuple[int, int]]) -> dict[tuple[int, int], Rows]:
    """The vectors of one stripe by (size, cell), on the driver."""

    def run(batches):
        for size, some, rows, _, home, _ in _slices(batches, pivots, radius):
            here = _stripes_of(size, home, some["node"].to_numpy(), plan) == stripe
            if here.any():
                raw = [r.tobytes() for r in rows[here]]
                yield pd.DataFrame({"size": size, "cell": home[here], "node": some["node"].to_numpy()[here], "n": some["n"].to_numpy()[here], "v": raw})

    found = vectors.select("node", "v", "n").mapInPandas(run, "size int, cell int, node long, n long, v binary").toPandas()
    out = {}
    for (size, cell), part in found.groupby(["size", "cell"]):
        part = part.sort_values("node")
        out[int(size), int(cell)] = Rows(part["node"].to_numpy(), np.frombuffer(b"".join(part["v"]), np.float64).reshape(-1, int(size)), part["n"].to_numpy())
    return out


class Groups:
    """Groups of places 0..n-1 joined step by step: `label` is the least place of a place's group."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Join all places `j` that are linked with the same row `i` (rising); returns the rows and a place of each one's group."""
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        two = self.label[j]
        least = np.minimum.reduceat(two, starts)
        one = np.repeat(least, np.diff(starts, append=len(i)))
        apart = np.flatnonzero(one != two)
        if len(apart):
            pairs = np.unique(one[apart] * len(self.label) + two[apart])
            ends, code = np.unique(np.divmod(pairs, len(self.label)), return_inverse=True)
            sets = UnionFind(len(ends))
            for a, b in code.reshape(2, -1).T.tolist():
                sets.union(a, b)
            to = np.arange(len(self.label))
            to[ends] = ends[[sets.find(k) for k in range(len(ends))]]
            self.label = to[self.label]
        return i[starts], least


def _groups(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each row and column of a link matrix: the least row of its group, -1 without links."""
    i, j = np.nonzero(near)
    of_row, of_column = np.full(near.shape[0], -1), np.full(near.shape[1], -1)
    if len(i):
        sets = Groups(near.shape[1])
        rows, _ = sets.join(i, j)
        first = np.searchsorted(i, rows)
        least = np.full(near.shape[1], near.shape[0])
        np.minimum.at(least, sets.label[j[first]], rows)
        of_row[rows], of_column[j] = least[sets.label[j[first]]], least[sets.label[j]]
    return of_row, of_column


def _frame(nodes: np.ndarray, near: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """(node, near, other): multiplicities (other null), and each linked node with one of its group (near 0)."""
    other = pd.Series(np.concatenate([np.zeros(len(nodes), np.int64), b[a != b]]), dtype="Int64")
    other[: len(nodes)] = pd.NA
    return pd.DataFrame({"node": np.concatenate([nodes, a[a != b]]), "near": np.concatenate([near, np.zeros(len(other) - len(nodes), np.int64)]), "other": other})


def _tile(residents: pd.DataFrame, others: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """(node, near, other) of two frames (node, v, n): linked multiplicity of each resident (other null), and group edges."""
    own, rows = (Rows(x["node"].to_numpy(), np.array(x["v"].tolist(), np.float64), x["n"].to_numpy()) for x in (residents, others))
    meeting = Meeting({(0, 0): rows})
    near, a, b = meeting.meet(own, (0, 0), np.zeros(len(own.nodes), bool), cosine)
    _, _, c, d = meeting.rest()
    return _frame(own.nodes, near, np.concatenate([a, c]), np.concatenate([b, d]))


class Meeting:
    """What a task knows of the residents of a stripe: their linked multiplicities and groups so far."""

    def __init__(self, residents: dict[tuple[int, int], Rows]) -> None:
        self.residents, self.start, n = residents, {}, 0
        for cell, rows in residents.items():
            self.start[cell], n = n, n + len(rows.nodes)
        self.nodes = np.concatenate([np.empty(0, np.int64), *(r.nodes for r in residents.values())])
        self.near, self.groups = np.zeros(n, np.int64), Groups(n)

    def meet(self, own: Rows, cell: tuple[int, int], later: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(linked multiplicity of each of `own`, edges of their groups); residents count the `later` ones among them."""
        others, start = self.residents[cell], self.start[cell]
        near, a, b = np.zeros(len(own.nodes), np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, j in _links(own, others, cosine):
            np.add.at(near, i, others.times[j])
            np.add.at(self.near, start + j, own.times[i] * later[i])
            rows, places = self.groups.join(i, start + j)
            a.append(own.nodes[rows])
            b.append(self.nodes[places])
        return near, np.concatenate(a), np.concatenate(b)

    def rest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(residents with later links, their multiplicity, edges of the residents' groups)."""
        seen = np.flatnonzero(self.near)
        return self.nodes[seen], self.near[seen], self.nodes, self.nodes[self.groups.label]


def range_join(vectors: DataFrame, pivots: dict[int, np.ndarray], cosine: float, tile: int = TILE) -> DataFrame:
    """(node, near, other): linked multiplicities (to be added up by node; the node itself included) and group edges."""
    radius = math.sqrt(2 - 2 * cosine)
    plan, stripes = plan_stripes(cell_counts(vectors, pivots, radius), tile)
    path, schema = f"{shared_dir(vectors.sparkSession)}/links-{uuid.uuid4().hex}", "node long, near long, other long"

    def compare(stripe: int, residents: dict[tuple[int, int], Rows]):
        cells: dict[int, list[int]] = {}
        for size, cell in residents:
            cells.setdefault(size, []).append(cell)

        def run(batches):
            meeting = Meeting(residents)
            for size, some, rows, unit, home, reach in _slices(batches, pivots, radius):
                stripes_met = _stripes_of(size, home, some["node"].to_numpy(), plan)
                if size not in cells or not (due := stripes_met >= stripe).any():
                    continue
                own, near, a, b = Rows(some["node"].to_numpy(), rows, some["n"].to_numpy(), unit), np.zeros(len(some), np.int64), [], []
                for cell in cells[size]:
                    spots = np.flatnonzero(due & reach[:, cell])
                    if len(spots):
                        found, left, right = meeting.meet(own.at(spots), (size, cell), stripes_met[spots] > stripe, cosine)
                        near[spots] += found
                        a.append(left)
                        b.append(right)
                linked = near > 0
                if linked.any():
                    yield _frame(own.nodes[linked], near[linked], np.concatenate(a), np.concatenate(b))
            nodes, near, a, b = meeting.rest()
            yield _frame(nodes, near, a, b)

        return run

    for stripe in range(stripes):
        residents = stripe_of(vectors, stripe, pivots, radius, plan)
        vectors.select("node", "v", "n").mapInPandas(compare(stripe, residents), schema).write.mode("append").parquet(path)
    return vectors.sparkSession.read.schema(schema).parquet(path) if stripes else vectors.sparkSession.createDataFrame([], schema)


def near_vectors(table: DataFrame, cosine: float = 0.95, pivots: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `table`."""
    if not 0 < cosine < 1:
        raise ValueError("cosine lies between 0 and 1")
    rows, vectors = distinct_vectors(table, id_col, vector_col)
    numbered = store(vectors.withColumn("node", F.monotonically_increasing_id()), "distinct_vectors")  # stored, so numbers stay
    n = numbered.count()
    centres = choose_pivots(numbered, pivots or int(min(2000, max(8, n / tile))))
    found = range_join(numbered, centres, cosine, tile)
    # hashes tell vectors apart unless two of the same hash exist; only then do the vectors themselves go through the joins
    by = ["key", "v"] if numbered.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() else ["key"]
    near = found.where("other is null").groupBy("node").agg(F.sum("near").alias("near"))
    linked = components(found.where("other is not null").select("node", "other"), "node", "other").withColumnRenamed("node", "c_node")
    groups = numbered.select("node", *by, "least").join(linked, F.col("node") == F.col("c_node"), "left").withColumn("c", F.coalesce("component", "node"))
    first = groups.groupBy("c").agg(F.min("least").alias("component_id"))
    named = groups.join(first, "c").join(near, "node").select(*by, "near", "component_id")
    joined = rows.select("vec_id", *by).join(named, by, "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = joined.select("vec_id", F.coalesce(F.col("near") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("component_id", F.when(F.col("vec_id").isNotNull(), F.col("component_id"))).withColumn("kept", F.col("vec_id") == F.col("component_id"))
