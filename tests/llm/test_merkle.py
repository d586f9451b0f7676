import zlib
from hashlib import sha256

from modalframe.llm import merkle
from modalframe.llm.merkle import check_inclusion, manifest, manifest_digest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string"


def H(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    fields = (row[0], row[3], row[2], row[4], text)
    return H("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(nodes):
    """Levels of a tree; each node is (digest, children)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        run = at - at % 8
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 8])))
        at //= 8
    return out


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row, leaf_of(row, row[1])))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda p: (p[0][0] is not None, p[0][0] or 0, p[1]))
        trees[g] = climb([leaf for _, leaf in groups[g]])
    top = climb([trees[g][-1][0] for g in order])
    root, out = top[-1][0], []
    for k, g in enumerate(order):
        for at, (row, leaf) in enumerate(groups[g]):
            steps = path(trees[g], at) + path(top, k)
            assert check_inclusion(leaf, steps, root)
            start = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None:
                start = leaf_of(row, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[1]))
            folded = start
            for before, after in steps:
                folded = H(before + folded + after)
            out.append((g, row[0], leaf, trees[g][-1][0], root, H("".join(b + a for b, a in steps)), folded, folded == root))
    return out


def same(spark, rows, parts=4):
    found = manifest_digest(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    assert found.columns == ["lang", "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute(rows), key=repr)


def row(k, lang, text="Some Text"):
    return (k, text, lang, "web", 9, "clash")


def test_odd_rows(spark):
    rows = [row(k, "en", f"Text {k}") for k in range(70)] + [row(k, "dé", "low") for k in range(9)] + [row(5, None), row(6, ""), row(7, "zz", None), row(8, "zz", "")]
    rows += [(None, "No Id", "en", None, None, "")] * 3 + [row(3, "en", "Text 3")] * 20 + [row(3, "en", "Other")]
    same(spark, rows)


def test_sizes(spark):
    same(spark, [row(k, f"g{n}") for n in (1, 2, 7, 8, 9, 63, 64, 65) for k in range(n)])


def test_lone_leaf_is_the_root(spark):
    same(spark, [row(4, "en")])


def test_several_layers_and_many_groups(spark, monkeypatch):
    """With blocks of 8^2 nodes a few hundred rows need three layers, and 100 groups a tree of two."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 64)
    same(spark, [row(k, "en", f"Text {k % 7}") for k in range(4200)] + [row(k, f"g{k}") for k in range(100)])


def test_full_block_boundary(spark):
    same(spark, [row(k, "en") for k in range(4097)] + [row(k, "de") for k in range(4096)])


def test_empty(spark):
    assert manifest_digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_fields(spark):
    rows = spark.createDataFrame([(1, "a", "A"), (2, "a", "B")], "k long, g string, t string")
    found = manifest(rows, ("k", "t"), "k", "g", "t").collect()
    leaves = [H("1:11:A"), H("1:21:B")]
    assert [r.leaf for r in sorted(found, key=lambda r: r.id)] == leaves and {r.root for r in found} == {H("".join(leaves))}
