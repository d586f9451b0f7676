import numpy as np

from modalframe.llm.decontam import Block, decontaminate, drop_contaminated, tile


def plain_tile(doc, item, seed):
    """Textbook greedy string tiling; ties go to the first place in the document, then in the item."""
    d, m, marked = [False] * len(doc), [False] * len(item), 0
    while True:
        longest, found = seed - 1, []
        for p in range(len(doc)):
            for q in range(len(item)):
                k = 0
                while p + k < len(doc) and q + k < len(item) and doc[p + k] == item[q + k] and not d[p + k] and not m[q + k]:
                    k += 1
                if k > longest:
                    longest, found = k, [(p, q)]
                elif k == longest and k >= seed:
                    found.append((p, q))
        if longest < seed:
            return marked
        for p, q in found:
            if not any(d[p : p + longest]) and not any(m[q : q + longest]):
                d[p : p + longest] = m[q : q + longest] = [True] * longest
                marked += longest


def test_tiling_matches_textbook(rng):
    for _ in range(60):
        item = rng.integers(0, 30, rng.integers(5, 40))
        parts = [item[a : a + rng.integers(3, 20)] for a in rng.integers(0, len(item), 4)]
        doc = np.concatenate([x for p in parts for x in (p, rng.integers(0, 40, 5))])
        assert tile(doc, item, 5) == plain_tile(doc.tolist(), item.tolist(), 5)


def test_tiling_of_one_word_repeated():
    assert tile(np.zeros(5000, np.int64), np.zeros(60, np.int64), 5) == 60
    assert tile(np.zeros(40, np.int64), np.zeros(60, np.int64), 5) == 40


def words(rng, n):
    return [f"w{k}" for k in rng.integers(0, 5000, n)]


def test_reordered_partial_and_clean(spark, rng):
    item = words(rng, 40)
    other = words(rng, 40)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, "a b c"), (4, ""), (None, None), (5, " ".join(item))], "item_id long, text string")
    halves = item[20:] + words(rng, 9) + item[:20]
    rows = [
        (1, " ".join(words(rng, 50) + item + words(rng, 50)).upper(), True, 1), (2, " ".join(halves), True, 1), (3, " ".join(item[:12] + words(rng, 100)), False, None),
        (4, " ".join(words(rng, 300)), False, None), (5, None, False, None), (6, "", False, None), (7, "x A b C y", True, 3), (7, "x A b C y", True, 3),
        (8, " ".join(item[:30] + other), True, 2), (None, " ".join(other), True, 2),
    ]
    docs = spark.createDataFrame([(a, b, 0.5, "z") for a, b, *_ in rows], "doc_id long, text string, coverage double, b0 string")
    for size in (1_000_000, 60):
        got = sorted(((r.doc_id, r.contaminated, r.item_id) for r in decontaminate(docs, bench, block_words=size).collect()), key=str)
        assert got == sorted(((a, c, d) for a, _, c, d in rows), key=str)
        kept = drop_contaminated(docs, bench, block_words=size)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert [tuple(r) for r in decontaminate(docs, none).collect()] == [(1, False, 0.0, None, 0, 0)]
    assert decontaminate(docs.limit(0), none).count() == 0


def test_whole_table_against_brute_force(spark, small_docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text.encode().lower().split()) for r in bench.collect()]
    truth = {}
    for r in small_docs.collect():
        text = (r.text or "").encode().lower().split()
        seeds = {tuple(text[i : i + 5]) for i in range(len(text))}
        shares = [plain_tile(text, i, min(5, len(i))) / len(i) for _, i in items if any(tuple(i[k : k + 5]) in seeds for k in range(len(i) - 4))]
        truth[r.doc_id] = max([0.0, *(s for s in shares if s >= 0.5)])
    got = {r.doc_id: r.coverage for r in decontaminate(small_docs, bench).collect()}
    assert got.keys() == truth.keys()
    assert [(k, v, got[k]) for k, v in truth.items() if abs(v - got[k]) > 1e-12] == []


def test_block_reports_best_item_once():
    block = Block([(9, "a b c d e f"), (3, "a b c d e f")], 5)
    assert block.leaks("z a b c d e f", 0.5) == (1.0, 3, 2, 12)
