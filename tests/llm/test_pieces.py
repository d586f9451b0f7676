import random
import time
from array import array

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from modalframe.llm.pieces import Pieces, WordMemo, decode_ids, encode_texts, load_pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ODD = ["", " ", "  ", "a", " a ", "a  b", "a   b    c ", "\n\nx\t y", "日本語 テキスト", "naïve café—ok", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "é 🤖🤖", "x" * 3000, " " * 41 + "x", "\x00\x01", "1234567890 3.14159"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def texts(spark):
    return ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


def ids_of(pieces, text):
    words = pieces.marked_words(text)
    known = pieces.segment(words)
    return [i for w in words for i in array("i", known[w])]


def test_merge_model_equals_library(library, texts):
    pieces = load_pieces(MODEL)
    for text in texts:
        assert ids_of(pieces, text) == library.encode(text), text[:80]
        assert pieces.decode(library.encode(text)) == text


def test_random_strings_equal_library(library):
    draw = random.Random(3)
    pieces = load_pieces(MODEL)
    for _ in range(2000):
        text = "".join(draw.choice("abcdeinrst  .,éßñ\n0") for _ in range(draw.randint(1, 40)))
        assert ids_of(pieces, text) == library.encode(text), repr(text)


def test_score_model_equals_library(texts):
    """The same table read as a unigram model, in the library and here."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    model.trainer_spec.byte_fallback = True
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    pieces = Pieces([(p.piece, p.score, p.type) for p in model.pieces], False)
    score = library.get_score

    def worth(ids):
        return sum(score(i) for i in ids if not library.is_byte(i))

    for word in sorted({w for t in texts if len(t) < 2500 for w in t.split(" ") if w}):  # short, as the library adds 32-bit scores
        mine, theirs = ids_of(pieces, word), library.encode(word)
        assert mine == theirs or worth(mine) >= worth(theirs), word
        assert pieces.decode(mine) == word


def test_model_without_bytes():
    pieces = Pieces([("<unk>", 0, 2), ("▁", -3, 1), ("a", -1, 1), ("▁a", -1.5, 1), ("ab", -2, 1), ("b", -4, 1)], False)
    assert ids_of(pieces, "ab a?!b") == [1, 4, 3, 0, 5]


def test_table_round_trip(spark, library):
    rows = [(1, None, 7), (2, "", 7), (3, "one two", 7), (3, "one two", 7), (None, "été \n x", 7), (4, "z " * 30000, 7), (5, "a▁b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_ids int")
    out = encode_texts(docs, MODEL)
    assert out.columns == ["doc_id", "text", "ids", "n_ids", "round_trip"]
    for r in out.collect():
        assert r.ids == library.encode(r.text or "") and r.n_ids == len(r.ids) and r.round_trip == (r.text is None or "▁" not in r.text)
    back = decode_ids(out.withColumnRenamed("text", "was"), MODEL).where("doc_id is null or doc_id < 5")
    assert back.where("coalesce(was, '') <> text").count() == 0
    assert encode_texts(docs.limit(0), MODEL).count() == 0


def test_memo_is_bounded(spark, library, small_docs):
    for r in encode_texts(small_docs, MODEL, memo=10).collect():
        assert r.ids == library.encode(r.text or "")


def test_runs_of_spaces_are_linear_and_equal_library(library):
    pieces = load_pieces(MODEL)
    for text in ("a" + " " * 37 + "b", " " * 5000 + "x", "  y" * 50, " " * 16):
        assert ids_of(pieces, text) == library.encode(text)
    began = time.time()
    pieces.segment(pieces.marked_words(" " * 100_000))
    assert time.time() - began < 3


def test_bytes_comparison_equals_decoding():
    pieces = load_pieces(MODEL)
    texts = ["", " ", "a b", " lead", "é中😀", "▁ mark", "�", "tail  ", "x" * 500]
    ids = [np.array(ids_of(pieces, text), np.int32) for text in texts]
    same = pieces.returns(np.concatenate(ids), [len(x) for x in ids], texts)
    assert same == [pieces.decode(x.tolist()) == t for x, t in zip(ids, texts)]


def test_words_that_come_again_are_segmented_once():
    pieces, met = load_pieces(MODEL), []

    class Counted:
        def segment(self, words):
            met.extend(words)
            return pieces.segment(words)

    memo, often = WordMemo(Counted(), 50), ["▁the", "▁and", "▁of"]
    for k in range(20):
        split = [[*often, *(f"▁rare{k}x{i}" for i in range(20))], often]
        known = memo.covering(split)
        assert {w: known[w] for words in split for w in words} == pieces.segment([w for words in split for w in words])
        assert len(memo.known) <= 50 and len(memo.older) <= 50
    assert len(met) == len(set(met)) == 3 + 20 * 20
