import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalframe.functions import text as T
from modalframe.functions import vectors as V
from modalframe.functions.patterns import decode_pattern, pattern_code, pattern_complexity, pattern_string
from modalframe.operators import modality, pooling
from modalframe.operators.embedding import embed_notes, model_encoder, text_embedding_table

NOTES = [
    None, "   ", "a.b.c", "x \t\n y", "keep [Report De-Identified 12] this **NAME** end", "dots..... dash----- ok", "[report DE-IDENTIFIED a] [b]",
    "Long sentence number one. " * 200, "n" * 3000, ("w" * 1535 + ". ") * 3,
]


def by_rules(text):
    """The documented cleaning and truncation, in Python."""
    if text is None:
        return ""
    t = re.sub(r"\s+", " ", text).strip()
    for pattern, repl, flags in [(r"\[Report de-identified.*?\]", "", re.I), (r"\*\*[^*]*\*\*", "", 0), (r"([a-zA-Z])\.([a-zA-Z])", r"\1. \2", 0), (r"\.{3,}", "...", 0), (r"-{3,}", "---", 0)]:
        t = re.sub(pattern, repl, t, flags=flags)
    if len(t) > 2048:
        kept, size = [], 0
        for s in t.split(". "):
            if size + len(s) >= 1536:
                break
            kept.append(s)
            size += len(s)
        t = ". ".join(kept)
        t = t if t.endswith(".") else t + "."
    return t.strip()


def test_notes_match_the_rules(spark):
    df = spark.createDataFrame(list(enumerate(NOTES)), "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", T.preprocess_note("t").alias("c")).collect()}
    assert got == {i: by_rules(t) for i, t in enumerate(NOTES)}


def one(spark, expr, **cols):
    names = ", ".join(f"{k} {t}" for k, (t, _) in cols.items())
    return spark.createDataFrame([tuple(v for _, v in cols.values())], names).select(expr.alias("o")).first()["o"]


@pytest.mark.parametrize("text, want", [
    ("[3, 4]", [0.6, 0.8, 0.0]), (" 3,4 ", [0.6, 0.8, 0.0]), ("[3,4", [0.6, 0.8, 0.0]), ("[NaN, 2, 0, 9]", [0.0, 1.0, 0.0]), ("[0,0]", [0.0] * 3),
    ("nonsense", [0.0] * 3), ("", [0.0] * 3), (None, [0.0] * 3), ("[1e300, x]", [0.0] * 3),
])
def test_parse_vector(spark, text, want):
    assert one(spark, V.parse_vector("t", 3), t=("string", text)) == pytest.approx(want)


def test_vector_arithmetic(spark):
    assert one(spark, V.fit_dim("v", 2), v=("array<double>", [1.0, 2.0, 3.0])) == [1.0, 2.0]
    assert one(spark, V.fuse(["a", "b"], ["f", "g"]), a=("array<double>", [2.0, 4.0]), b=("array<double>", [9.0, 9.0]), f=("int", 1), g=("int", 0)) == pytest.approx([2.0, 4.0])
    assert one(spark, V.masked_mean("t", "m"), t=("array<array<double>>", [[1.0, 2.0], [3.0, 4.0]]), m=("array<int>", [0, 1])) == [3.0, 4.0]
    assert one(spark, V.masked_mean("t", "m"), t=("array<array<double>>", [[1.0], [3.0]]), m=("array<int>", [0, 0])) == [0.0]
    assert one(spark, V.vector_text("v"), v=("array<double>", [0.1234567, -2.0])) == "[0.123457,-2.000000]"
    assert one(spark, V.mask_and_concat(["a", "b"], ["f", "g"]), a=("array<double>", [2.0]), b=("array<double>", [9.0]), f=("int", 0), g=("int", 1)) == [0.0, 9.0, 0.0, 1.0]
    assert one(spark, V.cosine("a", "b"), a=("array<double>", [2.0, 0.0]), b=("array<double>", [1.0, 1.0])) == pytest.approx(2**-0.5)


def test_pooling(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5, 4))
    rows = [(1, v.tolist()) for v in x] + [(2, [0.0] * 4), (2, [0.0] * 4), (3, x[0].tolist()), (4, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    w = np.linalg.norm(x, axis=1)
    want = {"mean": x.mean(0), "max_pool": x.max(0), "weighted_mean": (w[:, None] * x).sum(0) / w.sum(), "attention": x.mean(0)}
    for strategy, expected in want.items():
        got = {r["id"]: r["pooled"] for r in pooling.pool_vectors(df, "id", "v", strategy).collect()}
        assert got[1] == pytest.approx(expected.tolist()) and got[2] == [0.0] * 4 and got[3] == pytest.approx(x[0].tolist()) and 4 not in got


def test_flags_and_patterns(spark):
    subjects = spark.createDataFrame([(1,), (2,), (3,)], "subject_id long")
    images = spark.createDataFrame([(1, None), (1, None)], "subject_id long, embedding array<float>")
    texts = spark.createDataFrame([(1, " ", "r"), (2, "t", None), (2, "t", None)], "subject_id long, discharge_embedding string, radiology_embedding string")
    got = {r["subject_id"]: (r["missing_pattern"], r["pattern_code"]) for r in modality.availability_flags(subjects, images, texts).collect()}
    assert got == {1: ("1101", 13), 2: ("1010", 10), 3: ("1000", 8)}
    strict = {r["subject_id"]: r["missing_pattern"] for r in modality.availability_flags(subjects, images, texts, duplicates="none").collect()}
    assert strict == {1: "1101", 2: "1000", 3: "1000"}
    codes = spark.range(16).select(F.col("id").cast("int").alias("c"))
    got = {r["c"]: (r["d"], r["x"]) for r in codes.select("c", decode_pattern("c").alias("d"), pattern_complexity("c").alias("x")).collect()}
    for c, (d, x) in got.items():
        absent = 4 - bin(c).count("1")
        assert d == format(c, "04b")
        assert x == pytest.approx(0 if c == 15 else max(0, absent - 0.5 if c & 8 else absent - 0.3 if c & 4 else absent))
    flags = spark.createDataFrame([(1, 0, 1, 1)], "has_struct int, has_img int, has_text int, has_rad int")
    assert flags.select(pattern_code().alias("c"), pattern_string().alias("s")).first() == (11, "1011")


def test_note_embeddings_with_a_supplied_encoder(spark):
    def make():
        def predict(texts):
            return np.array([[len(t), 1.0] for t in texts], dtype=np.float64)

        return predict

    notes = spark.createDataFrame([(1, "discharge", "abc"), (1, "discharge", "abc"), (1, "radiology", " "), (2, "radiology", "x")], "subject_id long, note_type string, text string")
    emb = embed_notes(notes, model_encoder(make), dim=2)
    rows = {(r["subject_id"], r["note_type"]): (r["embedding"], r["n_notes"]) for r in emb.collect()}
    assert rows[(1, "discharge")] == (pytest.approx([3 / 10**0.5, 1 / 10**0.5]), 2) and rows[(1, "radiology")] == ([0.0, 0.0], 0)
    subjects = spark.createDataFrame([(1,), (2,), (3,)], "subject_id long")
    table = {r["subject_id"]: r for r in text_embedding_table(subjects, emb).collect()}
    assert table[1]["radiology_embedding"] is None and table[2]["radiology_embedding"] is not None and table[3]["discharge_embedding"] is None


def test_hashed_words_against_a_plain_count(spark):
    import hashlib
    import math

    texts = ["Blue sky, blue sea.", "sea and SKY 7", "...", "blue", "Äpfel äpfel"]
    dim = 16
    df = spark.createDataFrame([(i, "discharge", t) for i, t in enumerate(texts)], "subject_id long, note_type string, text string")
    got = {r["subject_id"]: r["embedding"] for r in embed_notes(df, dim=dim).collect()}
    slots = [[int(hashlib.md5(w.encode()).hexdigest()[:13], 16) % dim for w in re.findall(r"\w+", t.lower())] for t in texts]
    idf = [math.log((len(texts) + 1) / (sum(k in s for s in slots) + 1)) for k in range(dim)]
    for i, s in enumerate(slots):
        x = np.array([s.count(k) * idf[k] for k in range(dim)])
        assert got[i] == pytest.approx((x / (np.linalg.norm(x) or 1.0)).tolist())
    assert embed_notes(df.limit(0), dim=dim).count() == 0
    assert [r["embedding"] for r in embed_notes(df.filter("subject_id = 2"), dim=dim).collect()] == [[0.0] * dim]


def test_a_model_gets_texts_of_about_one_length(spark):
    def make():
        def predict(texts):
            return np.array([[max(map(len, texts)) - len(t), len(t), len(texts)] for t in texts], dtype=np.float64)

        return predict

    df = spark.createDataFrame([(i, "x" * (1 + i * 7 % 40)) for i in range(40)], "i long, t string").coalesce(1)
    rows = model_encoder(make, batch_size=8, normalize=False)(df, "t", "v").collect()
    assert all(r["v"][1] == len(r["t"]) and r["v"][0] <= 7 and r["v"][2] == 8 for r in rows) and len(rows) == 40
