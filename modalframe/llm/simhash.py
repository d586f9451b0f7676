"""SimHash near-duplicates: a binary-trie self-join of distinct fingerprints within an exact Hamming budget.

Texts become 64-bit fingerprints; equal fingerprints collapse before any join. Two fingerprints that differ in at most
`budget` bits agree on at least `blocks - budget` of `blocks` bit blocks, so every choice of that many blocks is a key and
each linked pair meets under one key. Under a key the fingerprints form a binary trie (a sorted array; a node is a
range). Node pairs are walked together from the root, each differing bit costs one unit, and pairs over budget are pruned
with all below them. A task reports a spanning forest of the links it finds, never the pairs. A key that holds very many fingerprints is
walked as pairs of bounded parts.

Nulls: a null text counts as empty, and an empty text has fingerprint zero and links like any other. A row without id gets a
fingerprint and the component of its fingerprint; it can bridge documents and is a representative only where its component
has no id at all (such a component has a null component_id). Repeated rows give repeated results. Extra columns are ignored by the
components and returned unchanged by `keep_representatives`, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UnionFind, components, free_name, store, words_of

LEAF = 2048  # node pairs with at most so many value pairs are compared directly
CHUNK = 65_536


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned SimHash over the word shingles of a text (repeats counted, XXH64 with seed 42)."""
    words = words_of(text)
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[i:j], 42) for i, j in zip(starts[:n].tolist(), ends[width - 1 :].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(bit) for bit in np.nonzero(ones * 2 > n)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the long columns `keys`: one row per row, fp the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            values = np.fromiter((fingerprint(t, width) for t in batch["text"]), np.uint64, len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": values.view(np.int64), **{k: batch[k] for k in keys}})

    schema = ", ".join(f"{c} long" for c in ("doc_id", "fp", *keys))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keys).mapInPandas(run, schema)


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where each node [lo, hi) parts by bit `depth` (0 is the highest)."""
    bit = np.uint64(1) << np.uint64(63 - depth)
    above = ~((bit << np.uint64(1)) - np.uint64(1)) if depth else np.uint64(0)
    return np.clip(np.searchsorted(values, (values[lo] & above) | bit), lo, hi)


def trie_links(values: np.ndarray, budget: int = 4) -> list[tuple[int, int]]:
    """Spanning forest (index pairs) of the links among sorted distinct uint64 values that differ in at most `budget` bits.

    Walks pairs of trie nodes; pairs whose members are all in one tree of the forest already are passed over.
    """
    n = len(values)
    if n < 2:
        return []
    sets, forest, root = UnionFind(n), [], np.arange(n)

    def compare(alo, ahi, blo, bhi):
        nonlocal root
        width = bhi - blo
        size = (ahi - alo) * width
        pair = np.repeat(np.arange(len(size)), size)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        i, j = alo[pair] + k // width[pair], blo[pair] + k % width[pair]
        near = (i < j) & (root[i] != root[j])
        i, j = i[near], j[near]
        near = np.bitwise_count(values[i] ^ values[j]) <= budget
        joined = False
        for x, y in zip(i[near].tolist(), j[near].tolist()):
            if sets.union(x, y):
                forest.append((x, y))
                joined = True
        if joined:
            root = np.fromiter((sets.find(x) for x in range(n)), np.int64, n) if n < 4096 else _flatten(sets)

    one = np.array([0])
    stack = [(0, one, one + n, one, one + n, one)]
    while stack:
        depth, alo, ahi, blo, bhi, used = stack.pop()
        if len(alo) > CHUNK // 16:
            half = len(alo) // 2
            stack += [(depth, *(x[half:] for x in (alo, ahi, blo, bhi, used))), (depth, *(x[:half] for x in (alo, ahi, blo, bhi, used)))]
            continue
        size = (ahi - alo) * (bhi - blo)
        small = size <= LEAF if depth < 64 else np.ones(len(size), bool)
        if small.any():
            picks = np.nonzero(small)[0]
            for part in np.array_split(picks, max(1, int(size[picks].sum()) // (4 * CHUNK))):
                if len(part):
                    compare(alo[part], ahi[part], blo[part], bhi[part])
        rest = ~small
        if not rest.any():
            continue
        alo, ahi, blo, bhi, used = (x[rest] for x in (alo, ahi, blo, bhi, used))
        open_ = np.array([root[a:b].min() != root[a:b].max() or root[c:d].min() != root[c:d].max() or root[a] != root[c] for a, b, c, d in zip(alo, ahi, blo, bhi)])
        alo, ahi, blo, bhi, used = (x[open_] for x in (alo, ahi, blo, bhi, used))
        if not len(alo):
            continue
        amid, bmid, own = _split(values, alo, ahi, depth), _split(values, blo, bhi, depth), alo == blo
        sides = [
            (alo, amid, blo, bmid, used, None), (amid, ahi, bmid, bhi, used, None),
            (alo, amid, bmid, bhi, used + 1, None), (amid, ahi, blo, bmid, used + 1, ~own),
        ]
        parts = [[], [], [], [], []]
        for a, b, c, d, spent, where in sides:
            keep = (b > a) & (d > c) & (spent <= budget)
            if where is not None:
                keep &= where
            for part, x in zip(parts, (a, b, c, d, spent)):
                part.append(x[keep])
        merged = [np.concatenate(part) for part in parts]
        if len(merged[0]):
            stack.append((depth + 1, *merged))
    return forest


def _flatten(sets: UnionFind) -> np.ndarray:
    parent = np.array(sets.parent)
    while True:
        above = parent[parent]
        if (above == parent).all():
            return parent
        parent = above


def blocks_for(n_distinct: int, budget: int = 4) -> int:
    """Number of bit blocks: more, hence longer keys, as the distinct fingerprints grow. Any choice gives the same links."""
    blocks = budget + 1
    while blocks < budget + 4 and n_distinct > 2 ** (64 * (blocks - budget) // blocks + 12):
        blocks += 1
    return blocks


def _walk(keys: list[str], budget: int, part: int):
    """Links inside each run of rows with equal `keys`, sorted by them and `fp`: rows (a, b, part -1).

    A key with more than two parts of `part` rows is not walked here: its rows come back cut into numbered parts of neighbours
    (a = b = fp, and the key). A task holds two parts and one batch, whatever the size of a key.
    """

    def links(frame):
        values = frame["fp"].to_numpy().view(np.uint64)
        values = values[np.argsort(values)]
        signed = values.view(np.int64)
        pairs = trie_links(values, budget)
        left, right = (np.array([signed[p[k]] for p in pairs], np.int64) for k in (0, 1))
        return pd.DataFrame({"a": left, "b": right, "part": -1})

    def parts(frame, first):
        fp = frame["fp"].to_numpy()
        return pd.DataFrame({"a": fp, "b": fp, "part": first + np.arange(len(fp)) // part, **{k: frame[k].to_numpy() for k in keys}})

    def run(batches):
        open_, given = None, 0  # rows of the last key so far, and its parts already passed on
        for batch in batches:
            frame = batch if open_ is None else pd.concat([open_, batch], ignore_index=True)
            values = [frame[k].to_numpy() for k in keys]
            edge = np.nonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values]))[0] + 1
            starts = np.concatenate([[0], edge]).astype(int)
            out = []
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if given and i == 0 or j - i > 2 * part:
                    out.append(parts(frame.iloc[i:j], given if i == 0 else 0))
                elif j - i > 1:
                    out.append(links(frame.iloc[i:j]))
            if len(starts) > 1:
                given = 0
            open_ = frame.iloc[starts[-1] :]
            full = (len(open_) - 1) // part  # a row stays, which names the key
            if given or full >= 2:
                out.append(parts(open_.iloc[: full * part], given))
                open_, given = open_.iloc[full * part :], given + full
            if out:
                yield pd.concat(out).reindex(columns=["a", "b", "part", *keys]).fillna(0).astype("int64")
        if open_ is not None and (given or len(open_) > 1):
            last = parts(open_, given) if given else links(open_)
            yield last.reindex(columns=["a", "b", "part", *keys]).fillna(0).astype("int64")

    return run


def _near_parts(ranges: DataFrame, budget: int) -> DataFrame:
    """(choice, bits, i, j), i <= j: pairs of parts whose common leading bits differ in at most `budget` places; others hold no link."""
    shared = F.when(F.col("lo") == F.col("hi"), 64).otherwise(64 - F.length(F.bin(F.col("lo").bitwiseXOR(F.col("hi")))))
    one = ranges.select("choice", "bits", F.col("part").alias("i"), F.col("lo").alias("lo_i"), shared.alias("n_i"))
    two = one.withColumnsRenamed({"i": "j", "lo_i": "lo_j", "n_i": "n_j"})
    n = F.least("n_i", "n_j")
    differing = F.when(n > 0, F.bit_count(F.expr("shiftrightunsigned(lo_i ^ lo_j, 64 - least(n_i, n_j))"))).otherwise(0)
    return one.join(two, ["choice", "bits"]).where((F.col("i") <= F.col("j")) & (differing <= budget)).select("choice", "bits", "i", "j")


def fingerprint_edges(distinct: DataFrame, budget: int = 4, blocks: int | None = None, part: int = 16_384) -> DataFrame:
    """(a, b): fingerprints joined by a spanning forest of each key's links; `distinct` has distinct values of `fp`.

    A key with more than `2 * part` fingerprints is cut into parts of neighbours in the sort order, and tasks walk pairs of parts. As a part
    is a stretch of the order, its members share leading bits, and pairs of parts that these bits hold too far apart are left out.
    """
    blocks = blocks or blocks_for(distinct.count(), budget)
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - budget)):
        mask = sum(((1 << cuts[k + 1]) - (1 << cuts[k])) for k in chosen)
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        keys.append(F.struct(F.lit(number).cast("long").alias("choice"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bits")))
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.choice", "k.bits", "fp")
    dealt = keyed.repartition("choice", "bits").sortWithinPartitions("choice", "bits", "fp")
    found = store(dealt.mapInPandas(_walk(["choice", "bits"], budget, part), "a long, b long, part long, choice long, bits long"), "links")
    edges, hot = found.where("part < 0").select("a", "b"), found.where("part >= 0")
    if hot.isEmpty():
        return edges
    near = _near_parts(hot.groupBy("choice", "bits", "part").agg(F.min("a").alias("lo"), F.max("a").alias("hi")), budget)
    tile = ["choice", "bits", "i", "j"]
    ends = near.select(*tile, F.explode(F.array_distinct(F.array("i", "j"))).alias("part"))
    tiled = hot.select("choice", "bits", "part", F.col("a").alias("fp")).join(ends, ["choice", "bits", "part"]).select(*tile, "fp")
    tiled = tiled.repartition(*tile).sortWithinPartitions(*tile, "fp")
    across = tiled.mapInPandas(_walk(tile, budget, part), f"a long, b long, part long, {', '.join(f'{k} long' for k in tile)}")
    return edges.unionByName(across.select("a", "b"))


def _fingerprint_components(fps: DataFrame, budget: int, blocks: int | None) -> DataFrame:
    """(fp, c, component_id): for each distinct fingerprint of `fps` (doc_id, fp) its component, never null, and the least id in it."""
    classes = store(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    linked = components(fingerprint_edges(classes.select("fp"), budget, blocks), "a", "b")
    named = classes.join(linked, classes["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    first = named.groupBy("c").agg(F.min("least").alias("component_id"))
    return named.join(first, "c").select("fp", "c", "component_id")


def simhash_components(docs: DataFrame, budget: int = 4, width: int = 4, blocks: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs` (doc_id, text)."""
    fps = store(fingerprints(docs, width=width), "fingerprints")
    final = _fingerprint_components(fps, budget, blocks).select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(final, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, budget: int = 4, width: int = 4, blocks: int | None = None) -> DataFrame:
    """Exactly one row of `docs` for each component: the one with the smallest id (rows without id last), of several the first stored."""
    row = free_name(docs, "__row")
    numbered = store(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")  # stored, so row numbers stay
    fps = store(fingerprints(numbered, width=width, keys=(row,)), "fingerprints")
    named = fps.join(_fingerprint_components(fps, budget, blocks).select("fp", "c"), "fp")
    first = named.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)).alias("first"))
    return numbered.join(first.select(F.col("first")[row].alias(row)), row, "left_semi").select(*(numbered[c] for c in docs.columns))
