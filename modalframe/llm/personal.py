"""Personal data: fixed base patterns, and a semi-Markov conditional random field that adds what the patterns miss.

Base spans (email, ip, card, phone) are leftmost non-overlapping matches that pass a check. The random field reads the surroundings of
digits and @ signs as letter runs, digit runs and single characters. A segmentation cuts them into outside tokens and
entities of a type; an entity of at most `LONGEST` tokens is scored as a whole (digit count, grouping, separators, checksum, part
range, edges), not token by token. Dynamic programming over bounded entities picks boundaries and types jointly; fitting maximises the
conditional likelihood by forward-backward over the same candidates.

Silver segmentations for fitting are base spans, and variants of them as people write them (no country prefix, other separators,
spaced @), which the patterns do not match; made-up dates, versions and counts stand for numbers that are nobody's. Fitting uses the surroundings of anchors in at most `fit_docs` documents with the
smallest hash of their id (documented bound). Found entities that overlap no base span are added; base spans stay.

Nulls: a null text counts as empty and has no spans; a null id is kept. Repeated rows give repeated results. Positions are code points,
stop exclusive. Whole texts are read; the work per text is linear in its length.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows

KINDS = ("email", "ip", "card", "phone")
# The base patterns of the result's definition, without retries inside a run.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
ANCHOR = re.compile(r"[0-9@]")
REACH, LONGEST, FIT_DOCS = 32, 24, 600
NUMERIC = frozenset(" ().-+/")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, stop) by kind, then start."""
    out = []
    if "@" in text:
        done = 0
        for m in DOMAIN.finditer(text):
            at = start = m.start()
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                done = m.end()
    if ANCHOR.search(text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                out.append((1, m.start(), m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Merged surroundings of anchors: runs of seven digits in `REACH` characters, and @ signs."""
    spans: list[list[int]] = []
    for m in re.finditer(r"[0-9][0-9\x20().+/-]{5,}[0-9]|[0-9]+(?:\.[0-9]+){2,}|@", text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    return [(a, b) for a, b in spans]


def span_features(kind: int, text: str, before: str, after: str) -> list[str] | None:
    """Whole-span features of a candidate; None if the span cannot be of that type."""
    if kind == 0:
        name, sign, host = text.partition("@")
        if not sign or not name or not host or "@" in host:
            return None
        inner, outer = name.strip(), host.strip()
        labels = outer.split(".")
        if not inner or " " in inner or " " in outer or name[0] == " " or host[-1] == " ":
            return None
        shape = [f"labels{min(len(labels), 4)}", f"empty{any(not x for x in labels)}", f"tld{labels[-1].isalpha()}{min(len(labels[-1]), 5)}", f"odd{any(not (c in LOCAL) for c in inner + outer)}"]
        shape += [f"gap{len(name) - len(inner) + len(host) - len(outer)}", f"start{inner[0].isalnum()}", f"stop{outer[-1].isalnum()}"]
    else:
        if any(not (c.isdigit() or c in NUMERIC) for c in text) or not text[-1].isdigit():
            return None
        groups = re.findall(r"[0-9]+", text)
        digits = "".join(groups)
        if not 7 <= len(digits) <= 19:
            return None
        marks = "".join(sorted(set(re.sub(r"[0-9]", "", text))))
        quad = len(groups) == 4 and marks == "." and all(len(g) <= 3 and int(g) <= 255 for g in groups)
        shape = [f"n{len(digits)}", f"groups{min(len(groups), 6)}", f"marks{marks}", f"quad{quad}", f"luhn{len(digits) >= 13 and luhn(digits)}", f"plus{text[0] == '+'}"]
        shape += [f"lengths{'-'.join(str(len(g)) for g in groups)}" if len(groups) <= 5 else "many", f"bracket{text.count('(')}{text.count(')')}", f"double{any(a in NUMERIC and a == b for a, b in zip(text, text[1:]))}"]
    edge = lambda c: "none" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c
    shape += [f"before {edge(before)}", f"after {edge(after)}", "bias"]
    return [f"{KINDS[kind]} {s}" for s in shape]


def candidate_segments(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int, list[str]]]:
    """(first token, last token + 1, kind, features) of every entity of at most LONGEST tokens."""
    out = []
    for i, (a, _) in enumerate(tokens):
        first = text[a]
        before = text[a - 1] if a else ""
        numeric = first.isdigit() or first in "+("
        mail = first in LOCAL or first == "@"
        digits, signs = 0, 0
        for j in range(i, min(len(tokens), i + LONGEST)):
            p, q = tokens[j]
            piece = text[p:q]
            numeric = numeric and (piece.isdigit() or piece in NUMERIC)
            mail = mail and (piece in "@ " or piece[0] in LOCAL)
            if not numeric and not mail or piece == "\n":
                break
            digits += q - p if piece.isdigit() else 0
            signs += piece == "@"
            after = text[q] if q < len(text) else ""
            if numeric and 7 <= digits <= 19 and piece.isdigit():
                for kind in (1, 2, 3):
                    if (f := span_features(kind, text[a:q], before, after)) is not None:
                        out.append((i, j + 1, kind, f))
            if mail and signs == 1 and piece.isalnum() and (f := span_features(0, text[a:q], before, after)) is not None:
                out.append((i, j + 1, 0, f))
            if signs > 1 and not numeric or digits > 19 and not mail:
                break
    return out


def decode(text: str, weights: dict[str, float]) -> list[tuple[int, int, int]]:
    """Best segmentation of one region: (kind, start, stop) of its entities. Outside tokens score 0."""
    tokens = [m.span() for m in TOKEN.finditer(text)]
    ending: dict[int, list[tuple[int, int, float]]] = {}
    for i, j, kind, f in candidate_segments(text, tokens):
        ending.setdefault(j, []).append((i, kind, sum(weights.get(x, 0.0) for x in f)))
    best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
    for j in range(1, len(tokens) + 1):
        best[j] = best[j - 1]
        for i, kind, score in ending.get(j, ()):
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, kind)
    out, j = [], len(tokens)
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            out.append((kind, tokens[i][0], tokens[j - 1][1]))
            j = i
    return out[::-1]


def _log_likelihood(n: int, segments, scores: np.ndarray, gold: set[tuple[int, int, int]]) -> tuple[float, np.ndarray]:
    """Log-likelihood of the gold entities and each segment's (gold minus expected) count, by forward-backward."""
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0.0
    ends, starts = {}, {}
    for k, (i, j, _, _) in enumerate(segments):
        ends.setdefault(j, []).append(k)
        starts.setdefault(i, []).append(k)
    for j in range(1, n + 1):
        forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[segments[k][0]] + scores[k] for k in ends.get(j, ()))])
    for i in range(n - 1, -1, -1):
        backward[i] = np.logaddexp.reduce([backward[i + 1], *(backward[segments[k][1]] + scores[k] for k in starts.get(i, ()))])
    total = forward[n]
    expected = np.array([math.exp(forward[i] + s + backward[j] - total) for (i, j, _, _), s in zip(segments, scores)])
    own = np.array([(i, j, kind) in gold for i, j, kind, _ in segments], float)
    return float(own @ scores - total), own - expected


def variants(text: str, spans: list[tuple[int, int, int]], draw: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The region with some entities rewritten the way people write them."""
    out, new, at = "", [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        value = text[a:b]
        if draw.random() < 0.5:
            if kind == 0:
                value = value.replace("@", draw.choice([" @ ", "@ ", " @"]))
            elif kind == 2:
                digits = re.sub(r"[^0-9]", "", value)
                value = draw.choice([".", "/"]).join(digits[k : k + 4] for k in range(0, len(digits), 4))
            elif kind == 3:
                digits = re.sub(r"[^0-9]", "", value)[-10:]
                value = draw.choice(["({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}"]).format(digits[:3], digits[3:6], digits[6:])
        out += text[at:a]
        new.append((kind, len(out), len(out) + len(value)))
        out, at = out + value, b
    return out + text[at:], new


def plain_numbers(draw: random.Random) -> str:
    """Numbers that are no personal data: dates with times, versions, counts, ranges."""
    n = lambda a, b: draw.randint(a, b)
    kinds = [
        f"{n(1900, 2099)}-{n(1, 12):02}-{n(1, 28):02} {n(0, 23):02}:{n(0, 59):02}", f"{n(1, 28):02}/{n(1, 12):02}/{n(1900, 2099)}", f"v{n(0, 9)}.{n(0, 40)}.{n(0, 99)}",
        f"{n(1, 999)},{n(100, 999)},{n(100, 999)}", f"{n(1000000, 99999999)} of {n(1000000, 99999999)}", f"{n(1900, 2000)}-{n(2001, 2099)}", f"no {n(10**6, 10**9)}",
    ]
    return f"the {draw.choice(kinds)} and"


def fit(windows: list[str], epochs: int = 6, decay: float = 0.02, seed: int = 3) -> dict[str, float]:
    """Weights by stochastic ascent on the conditional likelihood of base spans and their variants; no windows, no weights."""
    draw = random.Random(seed)
    examples = []
    for window in windows:
        for text, spans in ((window, base_spans(window)), variants(window, base_spans(window), draw), (plain_numbers(draw), [])):
            tokens = [m.span() for m in TOKEN.finditer(text)]
            first, last = {a: k for k, (a, _) in enumerate(tokens)}, {b: k + 1 for k, (_, b) in enumerate(tokens)}
            gold = {(first[a], last[b], kind) for kind, a, b in spans if a in first and b in last}
            if segments := candidate_segments(text, tokens):
                examples.append((len(tokens), segments, gold))
    weights: dict[str, float] = {}
    size: dict[str, float] = {}
    for _ in range(epochs):
        draw.shuffle(examples)
        for n, segments, gold in examples:
            scores = np.array([sum(weights.get(f, -0.5 if f.endswith("bias") else 0.0) for f in s[3]) for s in segments])
            _, change = _log_likelihood(n, segments, scores, gold)
            grad: dict[str, float] = {}
            for c, s in zip(change, segments):
                if abs(c) > 1e-4:
                    for f in s[3]:
                        grad[f] = grad.get(f, 0.0) + c
            for f, g in grad.items():
                w = weights.get(f, -0.5 if f.endswith("bias") else 0.0)
                g -= decay * w
                size[f] = size.get(f, 0.0) + g * g
                weights[f] = w + 0.3 * g / (1e-6 + math.sqrt(size[f]))
    return weights


def fit_field(docs: DataFrame, fit_docs: int = FIT_DOCS, per_doc: int = 3) -> dict[str, float]:
    """Weights from the anchor regions of a bounded sample of documents."""
    with_anchor = docs.where(F.rlike("text", F.lit("[0-9]{7}|[0-9]\\.[0-9]+\\.|@|\\+[0-9]")) & F.col("doc_id").isNotNull())
    ids = bounded_rows(with_anchor.select("doc_id").distinct(), F.col("doc_id"), fit_docs)

    def run(batches):
        for batch in batches:
            found = []
            for text in batch["text"]:
                found += [text[a:b] for a, b in regions(text) if b - a <= 600][:per_doc]
            yield pd.DataFrame({"w": found})

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text").mapInPandas(run, "w string").distinct()
    rows = bounded_rows(rows, F.col("w"), fit_docs * per_doc)  # an id may have any number of rows
    return fit(sorted(r.w for r in rows.collect()))


def all_spans(text: str | None, weights: dict[str, float]) -> tuple[list, list]:
    """(base spans, added spans) of one text."""
    if not text or not ANCHOR.search(text):
        return [], []
    base = base_spans(text)
    added = []
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = list(accumulate((b for _, b in taken), max))  # the furthest stop of a span and all before it: spans may lie inside each other
    for lo, hi in regions(text):
        for kind, a, b in decode(text[lo:hi], weights):
            a, b = a + lo, b + lo
            k = bisect_left(starts, b)
            if not k or reach[k - 1] <= a:
                added.append((kind, a, b))
    return base, added


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_personal_data(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans) of every row of `docs` (doc_id, text)."""
    slim = docs.select("doc_id", "text")
    weights = fit_field(slim, fit_docs)

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base, added = all_spans(text, weights)
            rows.append((*(sum(s[0] == k for s in base) for k in range(4)), len(added), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans"])

    return slim.select("doc_id", scan("text").alias("s")).select("doc_id", "s.*")
