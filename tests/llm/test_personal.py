import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from modalframe.llm.personal import KINDS, TOKEN, _log_likelihood, all_spans, base_spans, candidate_segments, decode, find_personal_data, fit, luhn


def plain_base(text):
    """The definition, with the standard matcher."""
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_matches_definition(small_docs):
    draw = random.Random(1)
    for _ in range(6000):
        text = "".join(draw.choice("1234567890000aZ.@+- ()é_%\n...@@++") for _ in range(draw.randint(0, 60)))
        assert base_spans(text) == plain_base(text), repr(text)
    for text in ["a@b.c@d.e", "@b.c@d.e", "1.2.3.4.5.6.7.8", "0001.0.0.255", "256.1.1.1", "1" * 20000, "a" * 20000, "+1" + " " * 100 + "2", "x@y", "4539578763621486"]:
        assert base_spans(text) == plain_base(text)
    for r in small_docs.collect():
        assert base_spans(r.text) == plain_base(r.text)


def test_likelihood_against_enumeration():
    text = "x 1234567 a@b.co 1.2.3.4567"
    tokens = [m.span() for m in TOKEN.finditer(text)]
    segments = candidate_segments(text, tokens)[:11]
    scores = np.linspace(-1, 1.5, len(segments))
    weight, own, total = [], np.zeros(len(segments)), 0.0
    for r in range(len(segments) + 1):
        for chosen in itertools.combinations(range(len(segments)), r):
            spans = sorted((segments[k][0], segments[k][1]) for k in chosen)
            if all(b <= c for (_, b), (c, _) in zip(spans, spans[1:])):
                w = math.exp(sum(scores[k] for k in chosen))
                total += w
                weight.append(w)
                own[list(chosen)] += w
    gold = {segments[0][:3]}
    value, change = _log_likelihood(len(tokens), segments, scores, gold)
    assert value == pytest.approx(scores[0] - math.log(total))
    assert change == pytest.approx(np.eye(len(segments))[0] - own / total)


def test_decoding_is_the_best_segmentation():
    text = "x +1 (743) 555-3824 a@b.co"
    tokens = [m.span() for m in TOKEN.finditer(text)]
    segments = candidate_segments(text, tokens)
    draw = random.Random(5)
    for _ in range(20):
        weights = {f: draw.uniform(-1, 1) for s in segments for f in s[3]}
        value = {s[:3]: sum(weights[f] for f in s[3]) for s in segments}
        best = [0.0] * (len(tokens) + 1)
        for j in range(1, len(tokens) + 1):
            best[j] = max([best[j - 1], *(best[i] + v for (i, e, _), v in value.items() if e == j)])
        ends = {b: k + 1 for k, (_, b) in enumerate(tokens)}
        starts = {a: k for k, (a, _) in enumerate(tokens)}
        assert sum(value[starts[a], ends[b], kind] for kind, a, b in decode(text, weights)) == pytest.approx(best[-1])


@pytest.fixture(scope="module")
def weights(spark):
    from modalframe.llm.personal import fit_field

    return fit_field(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_field_finds_other_spellings_and_leaves_numbers(weights):
    found = lambda t: [(KINDS[k], t[a:b]) for k, a, b in all_spans(t, weights)[1]]
    assert found("call (743) 555-3824 now") == [("phone", "(743) 555-3824")]
    assert found("mail bob.smith @ host.example.com please") == [("email", "bob.smith @ host.example.com")]
    assert found("card 4539.5787.6362.1486 ok") == [("card", "4539.5787.6362.1486")]
    for clean in ["on 2021-03-04 12:30 we", "version 1.22.3 of", "12,345,678 people", "between 1914 and 1918", "plain words"]:
        assert found(clean) == [], clean


def test_rows_and_edges(spark):
    rows = [(1, None), (2, ""), (None, "a@b.co"), (3, "x +1 (743) 555-3824 y"), (3, "x +1 (743) 555-3824 y"), (4, "1 2 " * 20000), (5, "é a.b@c-d.org 10.0.0.1 4539578763621486")]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, spans int")
    out = find_personal_data(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        base = plain_base(next(t for d, t in rows if d == r.doc_id) or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[0] == k for b in base) for k in range(4))
        listed = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and set(filter(None, listed.split(","))) <= set(r.spans.split(","))
    assert find_personal_data(docs.limit(0)).count() == 0
    assert fit([]) == {} and luhn("4539578763621486")


def test_added_spans_overlap_no_base_span():
    """A long base span with many others inside it: nothing may be added inside it, however many spans begin between."""
    text = "call " + "a@" + "@".join(f"b{k}.cc" for k in range(3)) + " " + ".".join(["x@y.zz"] * 1) + " mail " + "1.2.3.4@" * 10 + "d.ee 4111 1111 1111 1111"
    heavy = {f"{kind} bias": 50.0 for kind in KINDS} | {f"{k}:bias": 50.0 for k in range(len(KINDS))}
    for weights in ({}, heavy):
        base, added = all_spans(text, weights)
        assert base and not any(p < b and a < q for _, a, b in added for _, p, q in base)
