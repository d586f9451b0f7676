import sys
from pathlib import Path

import sentencepiece

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from modalframe.llm.decontam import decontaminate  # noqa: E402
from modalframe.llm.quality import score_quality  # noqa: E402

from .test_secrets import brute as brute_secrets  # noqa: E402
from .test_simhash import brute as brute_simhash  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_their_operators(spark):
    """Each stage's decision, redone by brute force (or the operator's own query) on the rows it was given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = docs.columns
    good = {r.doc_id for r in score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if r.doc_id in good]
    rows = [(d, t) for d, t in rows if d in {x for x, _, c in brute_simhash(rows) if x == c}]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaks = {r.doc_id for r in decontaminate(docs, bench).where("contaminated").collect()}
    rows = [(d, t) for d, t in rows if d not in leaks]
    want = {}
    for (d, text), found in zip(rows, brute_secrets(rows)):
        at, out = 0, ""
        for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in found[-1].split(",") if s):
            out, at = (out + text[at:a] + "[SECRET]" if a >= at else out), max(at, b)
        want[d] = out + text[at:]
    result = corpus_pipeline.run(spark, SF)
    assert result.columns == [*start, "ids", "n_ids", "round_trip"]
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECE_MODEL)
    got = result.collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)
    for r in got:
        assert r.ids == library.encode(r.text) and r.n_ids == len(r.ids) and r.round_trip and r.n_chars == len(r.text)


def test_stages_return_the_columns_they_got(spark):
    docs = spark.createDataFrame([(None, None, "en", "s", None, 1), (1, "", None, None, 0, 2), (1, "", None, None, 0, 2)], "doc_id long, text string, lang string, source string, n_chars long, ids int")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert k == 4 or out.columns == docs.columns
        out.count()
    assert len(corpus_pipeline.STAGES) == 5
