"""Secret scan in DataFrame functions only: base patterns, then a randomness test battery over token-like runs.

Base kinds (assign, access, hex) are leftmost non-overlapping pattern matches that pass a length condition. Positions come
from `split` and `regexp_extract_all` with one pattern: the pieces and matches alternate, so their lengths add up to starts.

The battery looks at maximal runs of token characters of 12 or more (of fewer, no p-value can reach a rate `q` of 0.01), and at the
parts of 12 or more between their marks. Each gets an encoding inferred from the characters it has
(hexadecimal, base-32, one-case alphanumeric, base-64) and, over that alphabet:
  - chi-squared for uniform use of the alphabet (Wilson-Hilferty approximation);
  - the runs test of symbols below and above the middle of the alphabet;
  - lag-1 serial correlation of symbol indices.
A run is random-like when none of the three rejects (smallest p-value times three at least `alpha`). Against that stands the
null that the run is written language, whose repetition rate (index of coincidence) is higher: a normal approximation,
whose spread shrinks with the length, gives its p-value. False discoveries are controlled at rate `q` by Benjamini-Hochberg over
all runs of the corpus within each length band, so short runs must earn more in a corpus full of them. P-values are counted
in logarithmic bins (upper edge used, so control is conservative): bands x bins rows reach the driver, whatever the corpus.

A part of an accepted run is no span of its own. Method spans (kind `random`) that overlap a base span are left out. Nulls: a null text counts as empty and has no spans; a null id is
kept. Repeated rows give repeated results. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns of the result's definition and their least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # a maximal run, so the length condition can stand in the pattern
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_-]{12,}"
PART = r"[A-Za-z0-9]{12,}"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: encoding: (pattern, alphabet, repetition rate of language over that alphabet)
ENCODINGS = (
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", 0.15),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567", 0.07),
    ("alnum", r"^([0-9a-z]+|[0-9A-Z]+)$", DIGITS + LOWER, 0.068),
    ("base64", r"^(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_-]+$", UPPER + LOWER + DIGITS + "+/", 0.06),
)
BANDS = (12, 16, 20, 24, 32, 40, 64, 128)
BINS_PER_DECADE, DECADES = 50, 12


SPAN = "array<struct<start:int,stop:int,kind:int,value:string>>"


def _bind(value: Column, fn) -> Column:
    """`fn` of a value that is computed once: Spark inlines columns, but not the variable of a higher-order function."""
    return F.transform(F.array(value), fn)[0]


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda p, v: p + v)


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """Array of (start, stop, kind, value) of the leftmost non-overlapping matches."""
    none = F.array().cast(SPAN)
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(state, pair):
        start = state["at"] + F.length(pair["piece"])
        stop = start + F.length(pair["value"])
        one = F.struct(start.alias("start"), stop.alias("stop"), F.lit(kind).alias("kind"), pair["value"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), found, lambda p, v: F.struct(p.alias("piece"), v.alias("value")))
    spans = F.aggregate(F.filter(pairs, lambda p: p["value"].isNotNull()), zero, step, lambda s: s["out"])
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(none)


def base_matches(text: Column) -> dict[str, Column]:
    return {
        "assign": F.filter(_matches(text, ASSIGN, 0), lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= LEAST_ASSIGN),
        "access": F.filter(_matches(text, ACCESS, 1), lambda m: F.length(m["value"]) >= LEAST_ACCESS),
        "hex": _matches(text, HEX, 2),
    }


def lower_tail(z: Column) -> Column:
    """Normal lower-tail probability: a rational approximation within 3 deviations, an asymptotic series beyond."""
    x = F.abs(z)
    t = 1 / (1 + 0.3275911 * x / math.sqrt(2))
    density = F.exp(-x * x / 2)
    near = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * density / 2
    far = density / (x * math.sqrt(2 * math.pi)) * (1 - 1 / (x * x) + 3 / F.pow(x, F.lit(4)))
    tail = F.when(x < 3, near).otherwise(far)
    return F.when(z <= 0, tail).otherwise(1 - tail)


def _with_tests(m: Column) -> Column:
    """The match with its encoding, p_random (smallest of the three times three) and p_text; encoding null if none applies."""
    value = m["value"]
    encoding, index, size, rate = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, pattern, alphabet, language in reversed(ENCODINGS):
        fits = F.rlike(value, F.lit(pattern))
        encoding = F.when(fits, F.lit(name)).otherwise(encoding)
        index = F.when(fits, F.lit(alphabet)).otherwise(index)
        size = F.when(fits, F.lit(float(len(alphabet)))).otherwise(size)
        rate = F.when(fits, F.lit(language)).otherwise(rate)
    return F.struct(*(m[c] for c in ("start", "stop", "kind", "value")), encoding.alias("encoding"), index.alias("alphabet"), size.alias("size"), rate.alias("rate"))


def _folded(m: Column) -> Column:
    """Symbols of the value as written in its alphabet: one-case encodings in the alphabet's case, url-safe marks as + and /."""
    value = m["value"]
    return (
        F.when(m["encoding"].isin("hex", "alnum"), F.lower(value))
        .when(m["encoding"] == "base64", F.translate(value, "-_", "+/"))
        .otherwise(value)
    )


def _tested(m: Column) -> Column:
    """(start, stop, kind, band, p_random, p_text) of a match with an inferred encoding."""
    symbols = F.filter(F.split(_folded(m), ""), lambda c: c != "")
    indices = F.transform(symbols, lambda c: F.instr(m["alphabet"], c).cast("double") - 1)
    return _bind(F.struct(m.alias("m"), indices.alias("x")), lambda s: _bind(_sums(s["m"], s["x"]), _p_values))


def _neighbours(x: Column, fn) -> Column:
    return _total(F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), fn))


def _sums(m: Column, x: Column) -> Column:
    n = F.size(x).cast("double")
    squares = _total(F.transform(F.sequence(F.lit(0), (m["size"] - 1).cast("int")), lambda k: F.pow(F.size(F.filter(x, lambda v: v == k)), F.lit(2.0))))
    above = _total(F.transform(x, lambda v: F.when(v >= m["size"] / 2, 1.0).otherwise(0.0)))
    changes = _neighbours(x, lambda a, b: F.when((a >= m["size"] / 2) == (b >= m["size"] / 2), 0.0).otherwise(1.0))
    moments = _bind(_total(x) / n, lambda c: F.struct(
        _total(F.transform(x, lambda v: (v - c) * (v - c))).alias("energy"), _neighbours(x, lambda a, b: (a - c) * (b - c)).alias("lagged")
    ))
    return F.struct(m.alias("m"), n.alias("n"), squares.alias("squares"), above.alias("above"), changes.alias("changes"), moments.alias("moments"))


def _p_values(s: Column) -> Column:
    m, n, squares, above = s["m"], s["n"], s["squares"], s["above"]
    size, below, energy = m["size"], n - above, s["moments"]["energy"]
    chi, freedom = squares * size / n - n, size - 1
    spread = 2 / (9 * freedom)
    p_chi = lower_tail((1 - spread - F.pow(F.greatest(chi, F.lit(0.0)) / freedom, F.lit(1 / 3))) / F.sqrt(spread))

    mean = 2 * above * below / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = F.when((above > 0) & (below > 0) & (variance > 0), 2 * lower_tail(-F.abs(s["changes"] + 1 - mean) / F.sqrt(variance))).otherwise(0.0)
    p_serial = F.when(energy > 0, 2 * lower_tail(-F.abs(s["moments"]["lagged"] / energy + 1 / n) * F.sqrt(n))).otherwise(0.0)

    coincidence = (squares - n) / (n * (n - 1))
    deviation = F.sqrt(2 * m["rate"] * (1 - m["rate"]) / (n * (n - 1)) + 1.12 * m["rate"] * m["rate"] / n)
    band = sum((F.when(n >= b, 1).otherwise(0) for b in BANDS[1:]), F.lit(0))
    return F.struct(
        m["start"].alias("start"), m["stop"].alias("stop"), m["kind"].alias("kind"), band.alias("band"),
        (3 * F.least(p_chi, p_runs, p_serial)).alias("p_random"), lower_tail((coincidence - m["rate"]) / deviation).alias("p_text"),
    )


def candidates(text: Column) -> Column:
    """Token-like runs, and parts between the marks of runs, that have an inferred encoding, with their tests."""

    def parts(m):
        shifted = F.transform(_matches(m["value"], PART, 3), lambda x: F.struct(
            (m["start"] + x["start"]).alias("start"), (m["start"] + x["stop"]).alias("stop"), x["kind"].alias("kind"), x["value"].alias("value")
        ))
        return F.when(F.rlike(m["value"], F.lit("[+/_-]")), F.concat(F.array(m), shifted)).otherwise(F.array(m))

    found = F.flatten(F.transform(_matches(text, CANDIDATE, 3), parts))
    encoded = F.filter(F.transform(found, _with_tests), lambda m: m["encoding"].isNotNull())
    return F.transform(encoded, _tested)


def _bin(p: Column) -> Column:
    """0 for the smallest p-values; a bin's upper edge is 10 ** ((bin - DECADES * BINS_PER_DECADE) / BINS_PER_DECADE)."""
    return F.ceil(F.log10(F.greatest(p, F.lit(10.0**-DECADES))) * BINS_PER_DECADE).cast("int") + DECADES * BINS_PER_DECADE


def length_cuts(docs: DataFrame, q: float) -> list[float]:
    """For each length band the largest p_text that Benjamini-Hochberg accepts over all runs of the corpus, or -1."""
    text = F.coalesce(docs["text"], F.lit(""))
    runs = docs.where(F.rlike(text, F.lit(CANDIDATE))).select(F.explode(candidates(text)).alias("c"))
    counted = runs.groupBy(F.col("c.band").alias("band"), _bin(F.col("c.p_text")).alias("bin")).count()
    rows = sorted((r.band, r.bin, r["count"]) for r in counted.collect())  # at most bands x bins
    cuts = []
    for band in range(len(BANDS)):
        own = [(b, n) for k, b, n in rows if k == band]
        total, seen, cut = sum(n for _, n in own), 0, -1.0
        for b, n in own:
            seen += n
            edge = 10.0 ** ((b - DECADES * BINS_PER_DECADE) / BINS_PER_DECADE)
            if edge <= q * seen / total:
                cut = edge
        cuts.append(cut)
    return cuts


def span_columns(text: Column, cuts: list[float], alpha: float) -> list[Column]:
    """Arrays of (start, stop, kind) for each of KINDS; random ones do not overlap base ones."""
    slim = lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), m["kind"].alias("kind"))
    base = [F.transform(v, slim) for v in base_matches(text).values()]
    if not any(c >= 0 for c in cuts):
        return [*base, F.slice(base[-1], 1, 0)]
    limits = F.array(*(F.lit(float(c)) for c in cuts))
    chosen = F.filter(candidates(text), lambda m: (m["p_random"] >= alpha) & (m["p_text"] <= F.get(limits, m["band"])))
    inside = lambda a, b: (b["start"] <= a["start"]) & (a["stop"] <= b["stop"]) & (b["stop"] - b["start"] > a["stop"] - a["start"])
    whole = _bind(F.transform(chosen, slim), lambda spans: F.filter(spans, lambda a: ~F.exists(spans, lambda b: inside(a, b))))
    return [*base, whole]


def scan_spans(docs: DataFrame, q: float = 0.01, alpha: float = 0.003) -> DataFrame:
    """`docs` with a column `__secrets`: a struct of the arrays assign, access, hex and random of (start, stop, kind).

    Positions are code points, stop exclusive. A column of that name in `docs` is replaced.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    arrays = span_columns(text, length_cuts(docs, q), alpha)
    found = docs.withColumn("__secrets", F.struct(*(a.alias(k) for k, a in zip(KINDS, arrays))))
    s = F.col("__secrets")
    base = F.concat(s["assign"], s["access"], s["hex"])
    free = F.filter(s["random"], lambda r: ~F.exists(base, lambda b: (b["start"] < r["stop"]) & (r["start"] < b["stop"])))
    return found.withColumn("__secrets", s.withField("random", free))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find_secrets(docs: DataFrame, q: float = 0.01, alpha: float = 0.003) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of every row of `docs` (doc_id, text)."""
    found = scan_spans(docs.select("doc_id", "text"), q, alpha)
    s = F.col("__secrets")
    base = F.concat(s["assign"], s["access"], s["hex"])
    return found.select(
        "doc_id", *(F.size(s[k]).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.concat(base, s["random"])).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", q: float = 0.01, alpha: float = 0.003) -> DataFrame:
    """`docs` with every span, overlapping ones as one, replaced by `mark` in `text`; `n_chars`, where there is one, follows the text.

    All other columns come back unchanged, whatever their names; an empty table gives an empty result.
    """
    columns = {c: docs[c] for c in docs.columns}
    # the caller's columns travel in one struct, so no name of theirs meets one of ours
    found = scan_spans(docs.select(F.struct(*columns.values()).alias("row"), docs["text"].alias("text")), q, alpha)
    s, old = F.col("__secrets"), F.col("text")
    spans = F.array_sort(F.transform(F.concat(*(s[k] for k in KINDS)), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))))

    def step(state, x):
        new = F.concat(state["out"], F.substring(old, state["at"] + 1, x["start"] - state["at"]), F.lit(mark))
        return F.struct(F.greatest(state["at"], x["stop"]).alias("at"), F.when(x["start"] >= state["at"], new).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step, lambda x: F.concat(x["out"], F.substring(old, x["at"] + 1, F.length(old))))
    named = found.withColumn("__redacted", F.when(F.size(spans) > 0, done).otherwise(old))
    row, new = F.col("row"), {"text": F.col("__redacted")}
    if "n_chars" in columns:
        new["n_chars"] = F.when(F.size(spans) > 0, F.length("__redacted")).otherwise(row["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return named.select(*(new.get(c, row[c]).alias(c) for c in columns))
