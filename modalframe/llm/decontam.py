"""Benchmark decontamination by greedy string tiling.

Texts are word sequences (A-Z lower-cased). A document and a test item that share a seed, `seed` words in a row, are tiled:
the longest common run of unmarked words is found by running Karp-Rabin hashes (binary search on the length, hits verified
word by word), all non-overlapping runs of that length are marked, and so on down to the seed length. The share of
an item's words that ends up marked is its coverage; a document is contaminated when it covers an item to `threshold`
or more. Because runs may come in any order, shuffled passages are caught.

The test items are the stated query set: they go over all documents in blocks of at most about `block_words` words,
whatever their number, and each block is one expression over the text, so documents are neither shuffled nor compared.

Nulls and short cases: a null or empty text covers nothing; an item without words is ignored; an item shorter than the seed has
its own length as seed; an item with a null item_id counts, its id is reported as null. The best item is the one with the
highest coverage, ties to the smallest id. Repeated rows give repeated results. Extra columns are ignored.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

SEED = 5
THRESHOLD = 0.5
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
RESULT = "coverage double, item_id long, n_items long, n_words long"


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    out[1:] = np.multiply.accumulate(np.full(n, base, np.uint64))
    return out


def window_hashes(tokens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, valid) of each window of `width` tokens; a window with a negative token is not valid."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    with np.errstate(over="ignore"):
        values = (tokens + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        values ^= values >> np.uint64(32)
        hashed = np.zeros(n, np.uint64)
        if width <= 16:
            for k in range(width):
                hashed = hashed * BASE + values[k : k + n]
        else:
            total = np.concatenate([[np.uint64(0)], np.cumsum(values * _powers(BASE, len(values))[:-1])])
            hashed = (total[width:] - total[:-width]) * _powers(INVERSE, n)[:-1]
    barrier = np.concatenate([[0], np.cumsum(tokens < 0)])
    return hashed, barrier[width:] == barrier[:-width]


def tile(doc: np.ndarray, item: np.ndarray, seed: int) -> int:
    """Number of item tokens marked by greedy tiling; negative tokens match nothing."""
    doc, item = doc.copy(), item.copy()
    marked, longest = 0, len(item)
    while longest >= seed:
        low, high, width = seed - 1, longest, longest  # often all of what is left matches at once
        while low < high:
            (a, ok), (b, fine) = window_hashes(doc, width), window_hashes(item, width)
            if np.isin(a[ok], b[fine]).any():
                low = width
            else:
                high = width - 1
            width = (low + high + 1) // 2
        if low < seed:
            break
        (a, ok), (b, fine) = window_hashes(doc, low), window_hashes(item, low)
        free: dict[int, list[int]] = {}
        for q in np.nonzero(fine)[0][::-1].tolist():
            free.setdefault(int(b[q]), []).append(q)
        end = 0
        for p in np.nonzero(ok & np.isin(a, b[fine]))[0].tolist():
            places = free.get(int(a[p]))
            if p < end or not places:
                continue
            while places:
                q = places.pop()
                if (item[q : q + low] >= 0).all() and (doc[p : p + low] == item[q : q + low]).all():
                    doc[p : p + low] = -1
                    item[q : q + low] = -2
                    marked, end = marked + low, p + low
                    break
        longest = low if end else low - 1  # nothing marked: only a hash collision
    return marked


class Block:
    """A bounded set of test items, indexed by seed."""

    def __init__(self, items: list[tuple[int | None, str]], seed: int) -> None:
        self.vocab: dict[bytes, int] = {}
        self.items, self.by_width = [], {}
        rows: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            tokens = np.fromiter((self.vocab.setdefault(w, len(self.vocab)) for w in words), np.int64, len(words))
            width = min(seed, len(tokens))
            hashes, _ = window_hashes(tokens, width)
            rows.setdefault(width, []).append((hashes, np.full(len(hashes), len(self.items)), np.arange(len(hashes))))
            self.items.append((name, tokens))
        for width, parts in rows.items():
            hashes, item, place = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            self.by_width[width] = (hashes[order], item[order], place[order])

    def leaks(self, text: str | None, threshold: float) -> tuple:
        """(coverage, item_id, items at or over the threshold, words of them marked) for one document."""
        words = words_of(text)
        best, hits, total = (0.0, None), 0, 0
        if not words or not self.items:
            return (*best, hits, total)
        tokens = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.zeros(len(tokens) + 1, np.int32)
        np.cumsum(tokens < 0, out=unknown[1:])
        for width, (hashes, item, place) in self.by_width.items():
            at = np.nonzero(unknown[width:] == unknown[:-width])[0] if width <= len(tokens) else unknown[:0]
            if not len(at):
                continue
            own = window_hashes(tokens[at[:, None] + np.arange(width)].ravel(), width)[0][::width]
            lo = np.searchsorted(hashes, own)
            hi = np.searchsorted(hashes, own, "right")
            hit = hi > lo
            if not hit.any():
                continue
            at, spans = at[hit], {(i, j) for i, j in zip(lo[hit].tolist(), hi[hit].tolist())}
            seen = np.concatenate([np.arange(i, j) for i, j in spans])
            inside = np.zeros(len(tokens) + 1, np.int64)
            np.add.at(inside, at, 1)
            np.add.at(inside, at + width, -1)
            shared = np.cumsum(inside[:-1]) > 0
            edges = np.nonzero(shared & ~np.concatenate([[False], shared[:-1]]))[0]
            compact = np.insert(np.where(shared, tokens, -1), edges, -1)[np.insert(shared, edges, True)]
            for number in np.unique(item[seen]).tolist():
                name, wanted = self.items[number]
                cover = np.zeros(len(wanted), bool)
                for q in place[seen[item[seen] == number]].tolist():
                    cover[q : q + width] = True
                if cover.sum() < threshold * len(wanted):
                    continue  # no tiling can reach the threshold
                marked = tile(compact, wanted, width)
                share = marked / len(wanted)
                if share >= threshold:
                    hits, total = hits + 1, total + marked
                    best = max(best, (share, name), key=lambda x: (x[0], x[1] is not None, -(x[1] or 0)))
        return (*best, hits, total)


def _block_column(items: list, text: Column, seed: int, threshold: float) -> Column:
    block = Block(items, seed)

    @F.pandas_udf(RESULT)
    def leaks(texts: pd.Series) -> pd.DataFrame:
        rows = [block.leaks(t, threshold) for t in texts]
        out = pd.DataFrame(rows, columns=["coverage", "item_id", "n_items", "n_words"])
        out["item_id"] = out["item_id"].astype("Int64")
        return out

    return leaks(text)


def leak_columns(benchmark: DataFrame, text: Column, seed: int = SEED, threshold: float = THRESHOLD, block_words: int = 1_000_000) -> list[Column]:
    """One struct column (coverage, item_id, n_items, n_words) for each block of `benchmark` (item_id, text).

    Items below the threshold report coverage 0. The driver holds one block at a time; its size is about `block_words`.
    """
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    letters = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(letters / (2 * block_words)))
    columns = []
    for k in range(n_blocks):
        part = bench if n_blocks == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        columns.append(_block_column([(r.item_id, r.text) for r in part.collect()], text, seed, threshold))
    return columns


def decontaminate(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = THRESHOLD, **how) -> DataFrame:
    """(doc_id, contaminated, coverage, item_id, n_items, n_words) of every row of `docs` (doc_id, text)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    columns = leak_columns(benchmark, F.col("text"), seed, threshold, **how)
    found = slim.select("doc_id", *(c.alias(f"b{k}") for k, c in enumerate(columns)))
    names = [f"b{k}" for k in range(len(columns))]
    order = [F.struct(F.col(f"{b}.coverage").alias("c"), (-F.col(f"{b}.item_id")).alias("i")) for b in names]
    best = order[0] if len(order) == 1 else F.greatest(*order)
    total = lambda f: sum((F.col(f"{b}.{f}") for b in names[1:]), F.col(f"{names[0]}.{f}"))
    return found.select(
        "doc_id", (best["c"] >= threshold).alias("contaminated"), best["c"].alias("coverage"), (-best["i"]).alias("item_id"),
        total("n_items").alias("n_items"), total("n_words").alias("n_words"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = THRESHOLD, **how) -> DataFrame:
    """The rows of `docs` that cover no test item to the threshold."""
    clean = F.lit(True)
    for column in leak_columns(benchmark, docs["text"], seed, threshold, **how):
        clean = clean & (column["coverage"] < threshold)
    return docs.where(clean)
