import numpy as np
import pandas as pd
import pytest
import xxhash

from modalframe.llm.simhash import _walk, fingerprint, fingerprint_edges, keep_representatives, simhash_components, trie_links


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(pairs, nodes):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def brute(rows):
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    parent = list(range(len(fps)))
    for _ in range(len(fps)):
        before = list(parent)
        for i, (_, a) in enumerate(fps):
            for j, (_, b) in enumerate(fps):
                if (a ^ b).bit_count() <= 4:
                    parent[i] = parent[j] = min(parent[i], parent[j])
        if before == parent:
            break
    ids = {}
    for (d, _), p in zip(fps, parent):
        if d is not None:
            ids[p] = min(ids.get(p, d), d)
    return sorted(((d, f"{f:016x}", ids.get(p)) for (d, f), p in zip(fps, parent)), key=str)


def test_fingerprint_matches_definition():
    for text in [None, "", "One two", "a b c d e f g h a b c d", "É à É à x y z É", "w " * 5000]:
        assert fingerprint(text) == plain_fingerprint(text)


def test_trie_finds_all_links(rng):
    centres = rng.integers(0, 2**63, 20, dtype=np.uint64)
    values = [int(c) for c in centres]
    for c in centres:
        for _ in range(40):
            v = int(c)
            for b in rng.choice(64, rng.integers(1, 8), replace=False):
                v ^= 1 << int(b)
            values.append(v)
    values = np.unique(np.array(values, np.uint64))
    truth = [(i, j) for i in range(len(values)) for j in range(i) if (int(values[i]) ^ int(values[j])).bit_count() <= 4]
    nodes = range(len(values))
    assert closure(trie_links(values), nodes) == closure(truth, nodes)


@pytest.mark.parametrize("blocks", [5, 6])
def test_edges_by_blocks(spark, rng, blocks):
    base = rng.integers(0, 2**63, 30)
    values = sorted({int(v) ^ (sum(1 << int(b) for b in rng.choice(63, k, replace=False)) if k else 0) for v in base for k in (0, 2, 4, 5)})
    found = fingerprint_edges(spark.createDataFrame([(v,) for v in values], "fp long"), blocks=blocks).collect()
    truth = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4]
    assert closure([(r.a, r.b) for r in found], values) == closure(truth, values)


def near_values(rng, n):
    """Distinct values of which most share their high 32 bits, so a few keys hold nearly all, some within the budget of each other."""
    low = rng.integers(0, 2**18, n, dtype=np.int64) << 7
    return sorted({int(v) for v in np.concatenate([low | (0x5A5A5A5A << 32), low[: n // 4] ^ -(1 << 62), [0, -1]])})


@pytest.mark.parametrize("part", [16, 50, 10_000])
def test_hot_keys_are_walked_by_parts(spark, rng, part):
    values = near_values(rng, 700)
    df = spark.createDataFrame([(v,) for v in values], "fp long").repartition(3)
    got = closure([(r["a"], r["b"]) for r in fingerprint_edges(df, part=part).collect()], values)
    pairs = [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    assert got == closure(pairs, values)


def test_a_task_never_holds_a_hot_key(rng):
    """One key of 20,000 fingerprints in batches of any size: parts are full, numbered on, and hold every row once."""
    fp = np.sort(rng.choice(2**40, 20_000, replace=False))
    frame = pd.DataFrame({"choice": np.r_[[0], np.ones(20_000), [2, 2]].astype(np.int64), "bits": 7, "fp": np.r_[[5], fp, [1, 3]]})
    for size in (1, 333, 2_500, 30_000):
        if size == 1:
            out = pd.concat(_walk(["choice", "bits"], 4, 500)(frame.iloc[i : i + 1] for i in range(18_000, len(frame))))
            want = fp[17_999:]
        else:
            out = pd.concat(_walk(["choice", "bits"], 4, 500)(frame.iloc[i : i + size] for i in range(0, len(frame), size)))
            want = fp
        hot = out[out["part"] >= 0]
        assert np.array_equal(hot["a"], want) and (hot["choice"] == 1).all()
        assert (hot.groupby("part").size().iloc[:-1] == 500).all() and sorted(set(hot["part"])) == list(range(-(-len(want) // 500)))
        assert out[out["part"] < 0][["a", "b"]].to_numpy().tolist() == [[1, 3]]


def test_components_match_brute_force(spark, rng):
    words = [f"w{i}" for i in range(60)]
    rows = [(None, None), (3, ""), (4, None), (4, None), (None, "x y z"), (9, "x y z")]
    for d in range(20, 50):
        text = list(rng.choice(words, 300))
        rows.append((d, " ".join(text)))
        text[5] = "other"
        rows.append((d + 100, " ".join(text)))
    docs = spark.createDataFrame([(d, t, 1, "q") for d, t in rows], "doc_id long, text string, fp int, component string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(docs).collect()), key=str)
    assert got == brute(rows)
    kept = keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(d for d, _, c in brute(rows) if d is not None and d == c)


def test_empty_table(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table_against_brute_force(small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(small_docs).collect()), key=str) == brute(rows)


def test_one_row_stays_of_each_component(spark, rng):
    """An id with two unlike texts, rows without id, and repeated rows: one row of each component, none lost."""
    a, b, c, d = (" ".join(f"w{k}" for k in rng.integers(0, 900, 200)) for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (None, c), (None, c), (7, d), (7, d), (None, d)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    kept = keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, a), (5, b), (None, c), (7, d)], key=str)


def test_clashing_names_come_back(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "own", "x"), (2, "a b c d e", "own", "y"), (3, "other words here now then", "mine", "z")], "doc_id long, text string, __row string, __ROW_ string")
    assert sorted(map(tuple, keep_representatives(docs).collect())) == [(1, "a b c d e", "own", "x"), (3, "other words here now then", "mine", "z")]
