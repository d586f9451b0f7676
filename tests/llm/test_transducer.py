import random

import numpy as np
import pytest
from modalframe.llm import transducer
from modalframe.llm.transducer import N_STATES, CUTS, TokenCounter, character_classes, chunk_maps, confirm_classes, count_tokens, prefix_scan, read_model
from tokenizers import Tokenizer

from .conftest import frame

MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = ["'s", "'re", "'ve", "'ll", "'", "r", "v", "l", "e", " ", "  ", "\n", "\t", "\xa0", "a", "b", "Z", "1", "23", "!", "?", "é", "中", "文", "😀", "́", "<|endoftext|>", "th", "ing", "\x85", "　", "²", "_", "'t", "S", "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(MODEL)


@pytest.fixture(scope="module")
def counter(library):
    return TokenCounter(*read_model(MODEL), confirm_classes(character_classes(), library.pre_tokenizer.pre_tokenize_str))


def expected(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def random_texts(n, most=40):
    rng = random.Random(5)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_counts_equal_library_on_random_texts(counter, library):
    texts = random_texts(20_000)
    assert counter.count(texts).tolist() == expected(library, texts)


def test_classes_equal_library_on_every_code_point(counter, library):
    """Any code point after a letter: one word exactly if it is a letter; likewise numbers."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for probe, kinds in (("a", lambda k: (k == 0) | (k >= 7)), ("1", lambda k: k == 1)):
        tried = library.pre_tokenizer.pre_tokenize_str("".join(f"{probe}{chr(c)}\n" for c in points))
        joined = {s // 3 for _, (s, e) in tried if s % 3 == 0 and e - s == 2}
        own = kinds(counter.classes[points])
        assert joined == set(np.nonzero(own)[0].tolist())


def test_small_table_is_compiled_anew_without_change(library, counter):
    texts = random_texts(5000)
    small = TokenCounter(*read_model(MODEL), counter.classes, max_states=500)
    assert small.count(texts).tolist() == expected(library, texts)
    assert len(small.machine.states) < 2000


def test_table_is_not_copied_and_equal_sets_are_held_once(library, counter):
    texts = random_texts(20_000)
    own = TokenCounter(*read_model(MODEL), counter.classes)
    table = own.machine.table
    assert own.count(texts).tolist() == expected(library, texts)
    assert len(own.machine.states) > 1024 and own.machine.table is table
    held = own.machine.blocked.values()
    assert len(held) > len(set(held)) == len(set(map(id, held)))


def test_small_memos_change_no_count(library, counter, monkeypatch):
    monkeypatch.setattr(transducer, "REMEMBERED", 50)
    texts = random_texts(3000)
    own = TokenCounter(*read_model(MODEL), counter.classes)
    assert own.count(texts).tolist() == expected(library, texts)
    assert len(own.machine.apart) <= 51 and len(own.machine.blocked) <= 51


def test_long_words_and_long_texts(counter, library):
    rng = random.Random(3)
    texts = ["a" * 50_000, " " * 50_000 + "x", "x y " * 400_000 + "\n\n" + "'re " * 9, "".join(rng.choice("abcdefgh") for _ in range(60_000)), "é" * 9000, "<|endoftext|>" * 3, "", None]
    assert counter.count(texts).tolist() == expected(library, texts)


def test_scan_composes_chunk_maps():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 15, 40 * 16).astype(np.int16) * N_STATES
    scanned = prefix_scan(chunk_maps(codes.reshape(40, 16)))
    for entry in range(N_STATES):
        state, exits = entry, []
        for k, code in enumerate(codes.tolist()):
            state = CUTS[code + state]
            if k % 16 == 15:
                exits.append(state)
        assert scanned[:, entry].tolist() == exits


def test_count_tokens_rows(spark, library):
    texts = ["Hello world", "", None, "a" * 600, "x " * 512, "x " * 513, "Hello world"]
    rows = [(k if k < 6 else None, t, "clash") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = sorted(map(tuple, count_tokens(docs, MODEL).collect()), key=str)
    counts = expected(library, texts)
    want = [(r[0], len((r[1] or "").encode()), n, n > 512) for r, n in zip(rows, counts)]
    assert found == sorted(want, key=str)
    assert count_tokens(frame(spark, []), MODEL).count() == 0


def test_query_on_documents(spark, small_docs, library):
    from modalframe.llm.catalog import QUERIES

    rows = QUERIES["op11_token_counts"](spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in small_docs.collect()}
    assert len(rows) == len(docs)
    assert {r.doc_id: r.n_tokens for r in rows} == dict(zip(docs, expected(library, list(docs.values()))))
    assert all(r.n_bytes == len((docs[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 512) for r in rows)
