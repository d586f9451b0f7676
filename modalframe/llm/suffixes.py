"""Removal of repeated passages by a sampled suffix array.

A byte goes if it lies in a `width`-byte string (400) that also starts somewhere else, in any text or the same one; overlaps count and
strings are judged on the input. Texts are UTF-8 bytes and matches never cross texts.

Suffixes are compared as short token strings; a token is a 64-bit fingerprint of a stretch of bytes. Records (tokens, text,
place) are range-partitioned by their leading tokens with sampled splitters, sorted inside each partition by multikey quicksort, and
compared with their neighbours, the last of a partition with the first of the next. Text and place take part in the range keys,
so equal suffixes, however many, spread over partitions. Three rounds keep the number of suffixes small:

1. Every `width`-byte window has an anchor, the least of the hashes of its 16-byte grams; windows in a row with one anchor are a run, about
   half a width long. A run whose whole stretch repeats is repeated (round 1 token string: the stretch). A run can hold a repeated
   window only if the half window before or after its anchor repeats, as equal windows have equal anchors at equal offsets.
2. Runs left open are cut into steps of 16 starts aligned on the anchor. If the union of a step's windows repeats, all its starts do; if their
   intersection does not repeat, none does.
3. Starts of steps left open are compared one by one (tokens: first and second half of the window).

A task makes records of two copies of a text at most: two occurrences are as good as a million, and a text that is a large share of all rows
does not flood the partitions of its suffixes. Texts are worked in pieces and records handed on piece by piece, so what a task holds besides the
text and its decisions has a bound, also where every byte starts a run (one character over and over). Rounds pass on only (text key, place); texts are keyed by 128 bits of content hash, so copies share their records' fate. Texts are shuffled
when decisions meet them, first all of them once, later only those with open runs.

Nulls: a null text counts as empty: no bytes, nothing removed, the hash of no bytes. A null id is kept. Repeated rows are copies of
each other like any others. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

WIDTH, GRAM, STEP = 400, 16, 16
PLACE_BITS = 24  # a text is worked in pieces of less than 2**24 bytes
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_draw = np.random.default_rng(20)
VALUES = [_draw.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in BASES]


class Prints:
    """Fingerprints of stretches of one text: prefix sums of value * base**i in 64-bit arithmetic, for two bases."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray) -> None:
        self.n = len(data)
        self.sums, self.inverse = [], []
        for k, base in enumerate(BASES):
            up, down = self.powers(k, self.n + 1)
            total = np.empty(self.n + 1, np.uint64)
            total[0] = 0
            np.cumsum(VALUES[k][data] * up[: self.n], out=total[1:])
            self.sums.append(total)
            self.inverse.append(down)

    @classmethod
    def powers(cls, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        held = cls._powers.get(k)
        if held is None or len(held[0]) < n:
            size = max(n, 4096)
            one = np.ones(1, np.uint64)
            held = tuple(np.concatenate([one, np.multiply.accumulate(np.full(size - 1, b, np.uint64))]) for b in (BASES[k], pow(BASES[k], -1, 1 << 64)))
            if size <= 1 << 21:
                cls._powers[k] = held
        return held

    def of(self, start: np.ndarray, stop: np.ndarray, k: int = 0) -> np.ndarray:
        """Fingerprint of each [start, stop), cut to the text; the length is part of it."""
        start, stop = (np.minimum(np.maximum(x, 0), self.n) for x in (start, stop))
        h = (self.sums[k][stop] - self.sums[k][start]) * self.inverse[k][start]
        h = (h ^ (h >> np.uint64(31)) ^ (stop - start).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(29))).view(np.int64)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours: block prefixes and suffixes."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    prefix = np.minimum.accumulate(rows, axis=1).ravel()
    suffix = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - width + 1], prefix[width - 1 : n])


def runs_of(data: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor) of the runs of windows that share their anchor (the leftmost least gram hash)."""
    if len(data) < width:
        return (np.empty(0, np.int64),) * 3
    h = VALUES[0][data]
    for size in (1, 2, 4, 8):
        h = h[:-size] * np.uint64(pow(BASES[0], size, 1 << 64)) + h[size:]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(BASES[1])
    packed = (h & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
    anchor = (sliding_least(packed, width - GRAM + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    cut = np.nonzero(anchor[1:] != anchor[:-1])[0]
    return np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(anchor) - 1]]), anchor[np.concatenate([[0], cut + 1])]


def pieces_of(n: int, size: int) -> list[tuple[int, int]]:
    """Pieces [a, b) of a text of n bytes: each window starts in exactly one, and lies whole in it."""
    return [(a, min(n, a + size + WIDTH - 1)) for a in range(0, max(1, n - WIDTH + 1), size)]


def multikey_order(tokens: list[np.ndarray]) -> np.ndarray:
    """Order of rows as token strings: sort by a token, then only inside groups that tie, by the next."""
    order = np.argsort(tokens[0], kind="stable")
    tied = np.concatenate([[False], tokens[0][order][1:] == tokens[0][order][:-1]])
    for token in tokens[1:]:
        group = np.cumsum(~tied)
        open_ = tied | np.concatenate([tied[1:], [False]])
        if not open_.any():
            break
        spots = np.nonzero(open_)[0]
        rows = order[spots]
        inner = np.lexsort((token[rows], group[spots]))
        order[spots] = rows[inner]
        same = np.concatenate([[False], token[order][1:] == token[order][:-1]])
        tied = tied & same
    return order


def repeated(records: DataFrame, per_part: int = 500_000) -> DataFrame:
    """The (h1, h2, place, kind, lead) of a stored table (kind, t1, t2, h1, h2, place) whose token string (kind, t1, t2) occurs at least twice.

    Rows with equal text key and place are occurrences in copies of one text, and count as two. `lead` marks at least one
    occurrence of each repeated string (one in each partition), which stands for it in later rounds.
    """
    spark = records.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, math.ceil(records.count() / per_part))
    dealt = records.repartitionByRange(parts, "t1", "t2", "kind", "h1", "h2", "place").withColumn("part", F.spark_partition_id())

    def run(batches):
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        frame = pd.concat(rows, ignore_index=True)
        tokens = [frame[c].to_numpy() for c in ("t1", "t2", "kind", "h1", "h2", "place")]
        order = multikey_order(tokens)
        a, b, c = (t[order] for t in tokens[:3])
        equal = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (c[1:] == c[:-1])
        hit = np.concatenate([equal, [False]]) | np.concatenate([[False], equal])
        out = frame.iloc[order].reset_index(drop=True)
        out["hit"] = hit
        out["lead"] = hit & ~np.concatenate([[False], equal])
        out["edge"] = 0
        out.loc[0, "edge"] = 1
        out.loc[len(out) - 1, "edge"] += 2
        yield out[out["hit"] | (out["edge"] > 0)]

    schema = "kind int, t1 long, t2 long, h1 long, h2 long, place long, part int, hit boolean, lead boolean, edge int"
    sorted_ = store(dealt.mapInPandas(run, schema), "suffixes")
    columns = ["h1", "h2", "place", "kind", "lead"]
    # partitions are in range order: the last row of one meets the first of the next that has rows; two rows a partition
    edges = sorted_.where("edge > 0").withColumn("side", F.explode(F.expr("filter(array(1, 2), x -> (edge & x) > 0)")))
    order = Window.orderBy("part", "side")
    token = F.struct("t1", "t2", "kind")
    beside = F.when(F.col("side") == 1, F.lag(token).over(order)).otherwise(F.lead(token).over(order))
    across = edges.select(*columns, (beside == token).alias("same")).where("same").withColumn("lead", F.lit(True))
    return sorted_.where("hit").select(*columns).unionByName(across.select(*columns))


RUN, BEFORE, AFTER, UNION, COMMON, START = range(6)


Rows = tuple[np.ndarray, ...]  # kind, t1, t2, h1, h2, place


def _rows(kind, t1, t2, h, place) -> Rows:
    n = len(place)
    return np.full(n, kind, np.int32), t1, t2, np.full(n, h[0]), np.full(n, h[1]), place


def _frame(parts: list[Rows]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("kind", "t1", "t2", "h1", "h2", "place"), map(np.concatenate, zip(*parts)))))


RECORD = "kind int, t1 long, t2 long, h1 long, h2 long, place long"


def _tokens(prints: Prints, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two tokens: the first half of a stretch by one base, all of it by the other."""
    return prints.of(start, start + (stop - start) // 2), prints.of(start, stop, 1)


def run_records(data: np.ndarray, h: tuple[int, int], size: int) -> Iterator[Rows]:
    """Round 1 of one text: each run's stretch, and the half windows beside its anchor; place: the run's first start."""
    for a, b in pieces_of(len(data), size):
        part = data[a:b]
        lo, hi, anchor = runs_of(part)
        if not len(lo):
            continue
        prints = Prints(part)
        half = WIDTH // 2
        t1, t2 = _tokens(prints, lo, hi + WIDTH)
        yield _rows(RUN, t1, t2 + (anchor - lo), h, lo + a)  # the anchor's offset is part of the comparison
        yield _rows(BEFORE, *_tokens(prints, np.maximum(0, anchor + GRAM - half), anchor + GRAM), h, lo + a)
        yield _rows(AFTER, *_tokens(prints, anchor, anchor + half), h, lo + a)


def _ranges(first: np.ndarray, count: np.ndarray, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(first, first + step, ... of each row, `count` of them; the row each belongs to)."""
    row = np.repeat(np.arange(len(first)), count)
    within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return first[row] + step * within, row


def _steps(lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, aligned first start) of the steps of runs: cuts at whole multiples of STEP from the anchor.

    A step at the end of a run may be short; its aligned start is where the full step would begin.
    """
    full = lo - (lo - anchor) % STEP
    aligned, run = _ranges(full, (hi - full) // STEP + 1, STEP)
    return np.maximum(aligned, lo[run]), np.minimum(aligned + STEP - 1, hi[run]), aligned


def _among(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which of `x` are in the ascending `places`."""
    if not len(places):
        return np.zeros(len(x), bool)
    return places[np.minimum(np.searchsorted(places, x), len(places) - 1)] == x


def _open(first: np.ndarray, all_: np.ndarray, near: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Which places need another round: near a repeat, and not settled or standing for others."""
    return _among(first, near) & (~_among(first, all_) | _among(first, lead))


def open_runs(data: np.ndarray, size: int, whole: np.ndarray, lead: np.ndarray, near: np.ndarray):
    """For each piece (offset, bytes, lo, hi, anchor) of its open runs."""
    for a, b in pieces_of(len(data), size):
        lo, hi, anchor = runs_of(data[a:b])
        keep = _open(lo + a, whole, near, lead)
        if keep.any():
            yield a, data[a:b], lo[keep], hi[keep], anchor[keep]


def step_records(data, h, size, whole, lead, near) -> Iterator[Rows]:
    """Round 2: the union of the windows of each step of the open runs, and what all windows of the full step share; place: first start."""
    for a, part, lo, hi, anchor in open_runs(data, size, whole, lead, near):
        prints = Prints(part)
        first, last, aligned = _steps(lo, hi, anchor)
        t1, t2 = _tokens(prints, first, last + WIDTH)
        yield _rows(UNION, t1, t2 + (first - aligned), h, first + a)
        yield _rows(COMMON, *_tokens(prints, aligned + STEP - 1, aligned + WIDTH), h, first + a)


def start_records(data, h, size, whole, lead, near, union, union_lead, common) -> Iterator[Rows]:
    """Round 3: the windows of the steps left open; place: the start."""
    for a, part, lo, hi, anchor in open_runs(data, size, whole, lead, near):
        first, last, _ = _steps(lo, hi, anchor)
        left = _open(first + a, union, common, union_lead)
        if left.any():
            prints = Prints(part)
            starts, _ = _ranges(first[left], (last - first)[left] + 1)
            yield _rows(START, *_tokens(prints, starts, starts + WIDTH), h, starts + a)


def removed_bytes(data: np.ndarray, size: int, whole: np.ndarray, lead: np.ndarray, near: np.ndarray, union: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which bytes go, from the decisions of all rounds."""
    change = np.zeros(len(data) + 1, np.int32)

    def mark(first, last):  # starts first..last repeat
        np.add.at(change, first, 1)
        np.add.at(change, last + WIDTH, -1)

    if len(whole):
        for a, b in pieces_of(len(data), size):
            lo, hi, _ = runs_of(data[a:b])
            keep = _among(lo + a, whole)
            mark(lo[keep] + a, hi[keep] + a)
    if len(union):
        for a, _, lo, hi, anchor in open_runs(data, size, whole, lead, near):
            first, last, _ = _steps(lo, hi, anchor)
            keep = _among(first + a, union)
            mark(first[keep] + a, last[keep] + a)
    mark(starts, starts)
    return np.cumsum(change[:-1]) > 0


RUN_SETS, STEP_SETS = ["whole", "lead", "near"], ["union", "union_lead", "common"]


def _by_text(hits: DataFrame, wanted: dict[str, tuple[tuple[int, ...], bool]]) -> DataFrame:
    """(h1, h2, one array of places for each name); wanted: kinds, and whether only leading occurrences count."""
    sets = [F.collect_set(F.when(F.col("kind").isin(*kinds) & (F.col("lead") | F.lit(not lead)), F.col("place"))).alias(n) for n, (kinds, lead) in wanted.items()]
    return hits.groupBy("h1", "h2").agg(*sets)


def _data(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def _places(places) -> np.ndarray:
    """A set of places, ascending: 8 bytes each, where a text may have as many as bytes."""
    return np.empty(0, np.int64) if places is None else np.sort(places)


def _records(texts: DataFrame, make, columns: list[str]) -> DataFrame:
    """The records of every text; of copies of one text that a task meets, only of the first two, which count like any number."""

    def run(batches):
        met: dict[tuple[int, int], bool] = {}  # text key -> met twice; two numbers a text of the task
        for batch in batches:
            out, n = [], 0
            for row in batch.itertuples(index=False):
                key = (row.h1, row.h2)
                if met.get(key):
                    continue
                met[key] = key in met
                for found in make(_data(row.text), (row.h1, row.h2), *(_places(getattr(row, c)) for c in columns)):
                    out.append(found)
                    n += len(found[0])
                    if n > 200_000:
                        yield _frame(out)
                        out, n = [], 0
            if out:
                yield _frame(out)

    return texts.select("text", "h1", "h2", *columns).mapInPandas(run, RECORD)


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _result(data: np.ndarray, gone: np.ndarray, keep_bytes: bool) -> tuple:
    kept = data[~gone].tobytes()
    spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
    return len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None


def remove_repeats(docs: DataFrame, piece: int = 1 << 17, keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of every row of `docs` (doc_id, text).

    `kept` is the remaining bytes, or null with `keep_bytes=False`.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text.alias("text"))
    keyed = keyed.select("*", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(7)).alias("h2"))
    first = store(_records(keyed, lambda d, h: run_records(d, h, piece), []), "runs")
    decided = _by_text(repeated(first), {"whole": ((RUN,), False), "lead": ((RUN,), True), "near": ((BEFORE, AFTER), False)})

    def settle(batches):
        """Texts without open runs get their result; the others pass on."""
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                whole, lead, near = (_places(x) for x in (row.whole, row.lead, row.near))
                if _open(near, whole, near, lead).any():
                    rows.append((row.doc_id, row.h1, row.h2, *[None] * 5, row.text, row.whole, row.lead, row.near))
                else:
                    data = _data(row.text)
                    rows.append((row.doc_id, row.h1, row.h2, *_result(data, removed_bytes(data, piece, whole, lead, near, _places(None), _places(None)), keep_bytes), *[None] * 4))
            yield pd.DataFrame(rows, columns=["doc_id", "h1", "h2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "text", *RUN_SETS]).astype({c: "Int64" for c in ("n_bytes", "n_removed", "n_spans")})

    sets = ", ".join(f"{c} array<long>" for c in RUN_SETS)
    joined = keyed.join(decided, ["h1", "h2"], "left").select("doc_id", "h1", "h2", "text", *RUN_SETS)
    settled = store(joined.mapInPandas(settle, f"doc_id string, h1 long, h2 long, {RESULT}, text string, {sets}"), "settled")
    open_ = settled.where("text is not null")
    texts = store(open_.groupBy("h1", "h2").agg(*(F.first(c).alias(c) for c in ("text", *RUN_SETS))), "open_texts")

    second = store(_records(texts, lambda d, h, *s: step_records(d, h, piece, *s), RUN_SETS), "steps")
    steps = store(_by_text(repeated(second), {"union": ((UNION,), False), "union_lead": ((UNION,), True), "common": ((COMMON,), False)}), "step_hits")
    third = store(_records(texts.join(steps, ["h1", "h2"]), lambda d, h, *s: start_records(d, h, piece, *s), [*RUN_SETS, *STEP_SETS]), "starts")
    starts = _by_text(repeated(third), {"starts": ((START,), False)})

    def finish(batches):
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                data = _data(row.text)
                gone = removed_bytes(data, piece, *(_places(x) for x in (row.whole, row.lead, row.near, row.union, row.starts)))
                rows.append((row.h1, row.h2, *_result(data, gone, keep_bytes)))
            yield pd.DataFrame(rows, columns=["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    fate = texts.join(steps.select("h1", "h2", "union"), ["h1", "h2"], "left").join(starts, ["h1", "h2"], "left")
    results = fate.select("h1", "h2", "text", *RUN_SETS, "union", "starts").mapInPandas(finish, f"k1 long, k2 long, {RESULT}")
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    done = settled.where("text is null").select(F.col("doc_id").cast("long").alias("doc_id"), *names)
    late = open_.select("doc_id", "h1", "h2").join(results, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    return done.unionByName(late.select(F.col("doc_id").cast("long").alias("doc_id"), *names))
