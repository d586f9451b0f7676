"""Merkle manifest of a dataset: leaf, subroot and root digests with an inclusion proof for every row.

H is the lowercase hex SHA-256 of its inputs laid end to end, digests as hex text. A leaf is H of the row's fields, each `-` if null, else its UTF-8
byte count, a colon and its value. In each group (lang) leaves ascend by id; while several nodes remain, every `FANOUT` neighbours
become one node. What remains is the group's subroot; subroots, ordered by group (null first, then by UTF-8 bytes), form the tree to the root likewise.

How it runs: the leaves are stored slim (id, group, digests; no text). A range partitioning by (group, id, leaf) and counts of its partitions give each leaf its
rank. The rank's octal digits are columns; four of them lie inside a block of 8^4 leaves, and are grouped away one after another: each step nests
its children, as an array of structs, into their node, and all steps share the one exchange that brought a block together. The block's root is a node of
the next layer, whose blocks are built in the same way, up to one block for each group, and then one tree over the groups. On the way back a transform over
a layer's nested struct writes, for each node, the digests before and after it on every level up to the root, and explode emits them as
rows; they meet their own nested blocks by grouping both together. At the leaves the transform emits each leaf's proof digest. No joins between leaves
and digests, no group larger than a block, and each row of any table holds one block at most.

Ties: rows of one id in a group are ordered by leaf digest; equal rows have equal leaves and stand side by side, each with the proof of its own place (which of the equal
rows has which place is not told apart). Null ids come first in their group, are never tampered, and a null group is a group of its own. Empty
texts are fields of 0 bytes. An empty table has no leaves and gives an empty result. Columns other than the five fields are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

FANOUT, LEVELS = 8, 4
BLOCK = FANOUT**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def leaf_digest(fields: list[Column]) -> Column:
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest(*parts)


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(grp, id, leaf, tampered): `tampered` is the leaf after lower-casing A-Z of the text where 3 divides crc32 of the id, else null."""
    own = {c: docs[c] for c in fields}
    changed = own | {text_col: F.translate(docs[text_col], UPPER, LOWER)}
    touched = F.crc32(F.encode(docs[id_col].cast("string"), "UTF-8")) % 3 == 0
    return docs.select(
        docs[group_col].alias("grp"), docs[id_col].alias("id"), leaf_digest(list(own.values())).alias("leaf"),
        F.when(touched, leaf_digest(list(changed.values()))).alias("tampered"),
    )


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` (a stored table) with `rank`, the place from 0 in its group by `order`, and `n`, the group's size.

    Rows are range-partitioned by (group, order, position in storage), sorted and numbered locally, so equal rows are dealt over partitions too. What a
    group has in earlier partitions comes from the counts by (group, partition), a few rows for each partition.
    """
    spread = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(F.col(group), *(F.col(c) for c in order), F.col("_tie"))
    numbered = spread.sortWithinPartitions(group, *order, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    numbered = store(numbered.withColumn("_part", F.shiftright("_at", 33)), "numbered")
    counts = numbered.groupBy(group, "_part").agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(group)
    places = counts.select(
        F.col(group).alias("_g"), F.col("_part").alias("_p"), (F.sum("_c").over(whole.orderBy("_part")) - F.col("_c") - F.col("_first")).alias("_shift"), F.sum("_c").over(whole).alias("n")
    )
    places = store(places, "places")
    met = numbered.join(places, numbered[group].eqNullSafe(places["_g"]) & (numbered["_part"] == places["_p"]))
    return met.select(*(numbered[c] for c in rows.columns), (F.col("_at") + F.col("_shift")).alias("rank"), "n")


def nest(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """One row per block of `nodes` (grp, rank, n, hash, payload...): (grp, block, n, hash of the block's root, tree).

    `tree` nests LEVELS arrays of (digit, hash, kids); the innermost kids are (digit, hash, payload). A level at which the whole group is one
    node hashes nothing: the node's only child stands for it.
    """
    shift = FANOUT.bit_length() - 1
    digits = [F.shiftright("rank", shift * k).bitwiseAND(FANOUT - 1).cast("int").alias(f"d{k}") for k in range(LEVELS)]
    dealt = nodes.select("grp", F.shiftright("rank", shift * LEVELS).alias("block"), "n", *digits, F.col("hash").alias("h"), *payload)
    dealt = dealt.repartition("grp", "block")
    item = F.struct(F.col("d0").alias("digit"), "h", *payload)
    for level in range(LEVELS):
        keys = ["grp", "block", "n", *(f"d{k}" for k in range(LEVELS - 1, level, -1))]
        kids = F.array_sort(F.collect_list(item))  # digits differ, so they decide
        merged = F.when(F.col("n") > FANOUT**level, F.sha2(F.array_join(F.col("kids.h"), ""), 256)).otherwise(F.col("kids")[0]["h"])
        dealt = dealt.groupBy(*keys).agg(kids.alias("kids")).withColumn("h", merged)
        if level + 1 < LEVELS:
            item = F.struct(F.col(f"d{level + 1}").alias("digit"), "h", "kids")
    return dealt.select("grp", "block", "n", F.col("h").alias("hash"), F.col("kids").alias("tree"))


def climb(nodes: DataFrame, payload: list[str]) -> list[DataFrame]:
    """Stored layers of blocks over `nodes` (grp, rank, n, hash, payload...), until each group is one block: its hash is the group's root."""
    layers = []
    while True:
        layers.append(store(nest(nodes, payload), "blocks"))
        largest = layers[-1].agg(F.max("n")).first()[0]
        if (largest or 0) <= BLOCK:
            return layers
        nodes, payload = layers[-1].select("grp", F.col("block").alias("rank"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), "hash"), []


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once."""
    return F.transform(F.array(value), body)[0]


def beside(kids: Column, digit: Column) -> Column:
    """struct(before, after): digests of the other children, each side laid end to end."""

    def side(kept):
        return F.array_join(F.transform(F.filter(kids, kept), lambda k: k["h"]), "")

    return F.struct(side(lambda k: k["digit"] < digit).alias("before"), side(lambda k: k["digit"] > digit).alias("after"))


def unnest(blocks: DataFrame, emit, keep: list[str]) -> DataFrame:
    """`keep` and the fields of `emit(child, rank, path)` for each innermost child of blocks that have `tree`, `n` and `path`.

    A path is an array of (before, after) by level from a node up to the root; levels at which nothing is hashed are not in it.
    """
    shift = FANOUT.bit_length() - 1

    def walk(kids: Column, level: int, rank: Column, above: Column) -> Column:
        def one(kid: Column) -> Column:
            own = F.when(F.col("n") > FANOUT**level, F.array(beside(kids, kid["digit"]))).otherwise(F.slice(above, 1, 0))
            place = F.shiftleft(rank, shift) + kid["digit"]
            return let(F.concat(own, above), lambda path: walk(kid["kids"], level - 1, place, path) if level else emit(kid, place, path))

        out = F.transform(kids, one)
        return F.flatten(out) if level else out

    rows = blocks.select(*keep, F.explode(walk(F.col("tree"), LEVELS - 1, F.col("block"), F.col("path"))).alias("_child"))
    return rows.select(*keep, "_child.*")


def descend(layers: list[DataFrame], paths: DataFrame, carried: list[str], emit) -> DataFrame:
    """`carried` and `emit(child, rank, path)` for each node that `climb` started from. `paths` (grp, block 0, path, carried...) has one row for each group.

    A layer's children are the blocks of the layer below: paths and blocks are laid together and grouped by (grp, block).
    """
    for depth in reversed(range(len(layers))):
        both = layers[depth].drop("hash").unionByName(paths, allowMissingColumns=True)
        met = both.groupBy("grp", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("tree", "n", "path", *carried)))
        if not depth:
            return unnest(met, emit, ["grp", *carried])
        paths = unnest(met, lambda kid, rank, path: F.struct(rank.alias("block"), path.alias("path")), ["grp", *carried])


def fold(start: Column, path: Column) -> Column:
    """The root that `start` leads to through the siblings of `path`."""
    return F.aggregate(path, start, lambda acc, s: digest(s["before"], acc, s["after"]))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(grp, id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of `docs`; grp is `group_col`, id is `id_col`."""
    base = store(leaves(docs, fields, id_col, group_col, text_col), "leaves")
    layers = climb(ranked(base, "grp", ["id", "leaf"]).withColumnRenamed("leaf", "hash"), ["id", "tampered"])
    tops = store(layers[-1].select(F.lit(0).alias("all"), "grp", "hash"), "subroots")
    groups = climb(ranked(tops, "all", ["grp"]).select(F.col("all").alias("grp"), F.col("grp").alias("name"), "hash", "rank", "n"), ["name"])
    nowhere = F.array().cast("array<struct<before: string, after: string>>")
    start = groups[-1].select("grp", "block", nowhere.alias("path"), F.col("hash").alias("root"))
    named = descend(groups, start, ["root"], lambda kid, rank, path: F.struct(kid["name"].alias("name"), kid["h"].alias("subroot"), path.alias("path")))
    paths = store(named.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("block"), "path", "subroot", "root"), "group_paths")

    def emit(kid, rank, path):
        changed = F.coalesce(kid["tampered"], kid["h"])
        return F.struct(kid["id"].alias("id"), kid["h"].alias("leaf"), proof_digest(path).alias("proof_sha256"), fold(changed, path).alias("folded_root"))

    rows = descend(layers, paths, ["subroot", "root"], emit)
    return rows.select("grp", "id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def manifest_digest(docs: DataFrame) -> DataFrame:
    """The manifest of a table of documents under its own column names."""
    return manifest(docs).withColumnsRenamed({"id": "doc_id", "grp": "lang"})


def check_inclusion(leaf: str, path: list[tuple[str, str]], root: str) -> bool:
    """Whether `leaf` and the digests beside it, level by level, lead to `root`: what a holder of one row and its path computes."""
    from hashlib import sha256

    return reduce(lambda acc, s: sha256((s[0] + acc + s[1]).encode()).hexdigest(), path, leaf) == root


#: DuckDB text of the query: the same tree as a recursive grouping, siblings met by joins, crc32 bit by bit.
ORACLE = """
WITH RECURSIVE fields AS (
  SELECT doc_id, lang,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda acc, c: list_reduce(list_concat([xor(acc, c)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))) AS crc
  FROM documents),
leaf AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
    CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) END AS tampered FROM fields),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
tree AS (
  SELECT lang, 0 AS lvl, idx, n, h FROM placed
  UNION ALL
  SELECT lang, lvl + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY lang, lvl, idx // 8),
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS lvl, idx, n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM upper_tree WHERE n > 1 GROUP BY lvl, idx // 8),
root AS (SELECT h AS root FROM upper_tree WHERE n = 1),
lower_beside AS (
  SELECT t.lang, t.lvl, t.idx, coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx < t.idx), '') AS b, coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx > t.idx), '') AS a
  FROM tree t JOIN tree s ON s.lang IS NOT DISTINCT FROM t.lang AND s.lvl = t.lvl AND s.idx // 8 = t.idx // 8 WHERE t.n > 1 GROUP BY ALL),
upper_beside AS (
  SELECT t.lvl, t.idx, coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx < t.idx), '') AS b, coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx > t.idx), '') AS a
  FROM upper_tree t JOIN upper_tree s ON s.lvl = t.lvl AND s.idx // 8 = t.idx // 8 WHERE t.n > 1 GROUP BY ALL),
in_group AS (
  SELECT lang, idx AS id, 0 AS lvl, idx, coalesce(tampered, h) AS folded, '' AS proof FROM placed
  UNION ALL
  SELECT p.lang, p.id, p.lvl + 1, p.idx // 8, sha256(s.b || p.folded || s.a), p.proof || s.b || s.a
  FROM in_group p JOIN lower_beside s ON s.lang IS NOT DISTINCT FROM p.lang AND s.lvl = p.lvl AND s.idx = p.idx),
top_of_group AS (SELECT * FROM in_group QUALIFY row_number() OVER (PARTITION BY lang, id ORDER BY lvl DESC) = 1),
above AS (
  SELECT p.lang, p.id, 0 AS lvl, s.idx, p.folded, p.proof FROM top_of_group p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
  UNION ALL
  SELECT p.lang, p.id, p.lvl + 1, p.idx // 8, sha256(s.b || p.folded || s.a), p.proof || s.b || s.a FROM above p JOIN upper_beside s ON s.lvl = p.lvl AND s.idx = p.idx),
done AS (SELECT * FROM above QUALIFY row_number() OVER (PARTITION BY lang, id ORDER BY lvl DESC) = 1)
SELECT p.lang, p.doc_id, p.h AS leaf, s.subroot, r.root, sha256(d.proof) AS proof_sha256, d.folded AS folded_root, d.folded = r.root AS verified
FROM placed p JOIN done d ON d.lang IS NOT DISTINCT FROM p.lang AND d.id = p.idx JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN root r
"""
