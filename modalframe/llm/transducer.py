"""Token counts by a tokenizer compiled to finite-state transducers.

A byte-level merge tokenizer is two deterministic machines in a row:

- `CUTS` reads character classes and says where words (pre-tokens) begin: twelve states, written down as a table. One transition may cut before the
  character it reads, before the one ahead of it (a space that belongs to the next word, a contraction that did not come about), or both.
- `MergeMachine` reads the bytes of a word. Its state holds, for each suffix of the input that begins some longer token, what matters of the
  token that ends where this suffix starts, and how many tokens fewer the input had there. One token may end at the new byte: the one whose left
  neighbour stays apart from it (the only path merging can leave). Each transition is annotated with the number of tokens it emits, which
  may be negative where two tokens become one; the sum over a word is its token count. Transitions are compiled when first met into one
  table of next state and output; a full table (`max_states`) is emptied and compiled anew, which changes no count.

Texts of a batch are laid end to end and cut into chunks of equal length. Each chunk's map (entry state -> exit state) over all twelve
states is computed for all chunks at once; the maps are composed by a parallel prefix scan, which gives each chunk its entry state; a second
step places the cuts. Then the words of the batch pass through the second machine in lock-step, and outputs are summed by row. Very
long texts are taken in parts that begin where a cut is certain, and very long words byte by byte, so memory follows the largest part.

Special strings inside a text are one token each, found before anything else, as the library does by default.

Nulls: a null text counts as empty and has 0 bytes and 0 tokens, as the empty text; a null id stays null. Rows are independent: repeated
rows give repeated results, an empty table an empty one. Columns of `docs` other than the id and the text are not read.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# character classes; the letters that contractions need have their own
LETTER, NUMBER, OTHER, QUOTE, SPACE, BLANK, END = range(7)
CONTRACTED = "stmdrvle"
N_CLASSES = 7 + len(CONTRACTED)
# states: nothing read yet, runs, a quote that begins a word, quote and r / v / l, one blank, several blanks (by whether the last is a space)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, QUOTED, Q_R, Q_V, Q_L, ONE_SPACE, ONE_BLANK, MANY_SPACE, MANY_BLANK = range(12)
N_STATES = 12
CUT, CUT_BEFORE = 1, 2
#: word starts certain in any state: a blank after something that is none
CERTAIN = re.compile(r"(?<=\S)[ \t\n\r]")
PART, CHUNK, LONG_WORD = 1 << 20, 256, 256
#: pairs of tokens held at once (either memo is emptied beyond that), factor of a pair's number, rows of a table beyond `max_states`, texts taken at a time
REMEMBERED, PAIRED, SPARE, TEXTS = 100_000, 1 << 32, 4096, 1000


def _cut_tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, events) by class * N_STATES + state."""
    begin = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, QUOTE: QUOTED, SPACE: ONE_SPACE, BLANK: ONE_BLANK, END: FRESH}
    going = {IN_LETTERS: {LETTER}, IN_NUMBERS: {NUMBER}, IN_OTHER: {OTHER, QUOTE}, QUOTED: {OTHER, QUOTE}}

    def step(state: int, kind: int, letter: str) -> tuple[int, int]:
        if state in (Q_R, Q_V, Q_L):
            if letter == {Q_R: "e", Q_V: "e", Q_L: "l"}[state]:
                return FRESH, 0
            after, event = step(IN_LETTERS, kind, letter)
            return after, event | CUT_BEFORE
        if state == QUOTED and letter in tuple("stmdrvl"):
            return {"r": Q_R, "v": Q_V, "l": Q_L}.get(letter, FRESH), 0
        if state in (ONE_SPACE, ONE_BLANK, MANY_SPACE, MANY_BLANK):
            if kind in (SPACE, BLANK):
                return (MANY_SPACE if kind == SPACE else MANY_BLANK), 0
            if kind == END:
                return FRESH, CUT
            event = {ONE_SPACE: 0, ONE_BLANK: CUT, MANY_SPACE: CUT_BEFORE, MANY_BLANK: CUT | CUT_BEFORE}[state]
            joined = state in (ONE_SPACE, MANY_SPACE)  # a quote after a space is no contraction
            return (IN_OTHER if joined and kind == QUOTE else begin[kind]), event
        if kind in going.get(state, ()):
            return (IN_OTHER if state == QUOTED else state), 0
        return begin[kind], CUT

    after, event = np.zeros(N_CLASSES * N_STATES, np.int16), np.zeros(N_CLASSES * N_STATES, np.uint8)
    for code in range(N_CLASSES):
        kind, letter = (code, "") if code < 7 else (LETTER, CONTRACTED[code - 7])
        for state in range(N_STATES):
            after[code * N_STATES + state], event[code * N_STATES + state] = step(state, kind, letter)
    return after, event


CUTS, EVENTS = _cut_tables()


def character_classes() -> np.ndarray:
    """Class of every code point; the one past the last code point is the end mark between texts."""
    every = "".join(map(chr, range(0xD800))) + " " * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.full(0x110001, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", BLANK)):
        for run in regex.finditer(pattern, every):
            out[run.start() : run.end()] = kind
    out[0xD800:0xE000] = OTHER
    out[ord(" ")], out[ord("'")], out[0x110000] = SPACE, QUOTE, END
    for k, letter in enumerate(CONTRACTED):
        out[ord(letter)] = 7 + k
    return out


def confirm_classes(classes: np.ndarray, pre_tokenize) -> np.ndarray:
    """`classes` where a library's pre-tokenizer agrees; letters and numbers it does not know (of later Unicode versions) are OTHER."""
    out = classes.copy()
    for kind, probe in ((LETTER, "a"), (NUMBER, "1")):
        for at in range(0, 0x110000, 0x10000):
            points = at + np.nonzero(classes[at : at + 0x10000] == kind)[0]
            points = points[points < 0x110000]
            tried = pre_tokenize("".join(f" {probe}{chr(c)}" for c in points.tolist()))
            joined = np.array([end // 3 - 1 for _, (start, end) in tried if end - start == 3], np.int64)
            out[np.delete(points, joined)] = OTHER
    return out


def chunk_maps(classes: np.ndarray) -> np.ndarray:
    """Exit state of each chunk (row) for each entry state (column), all chunks in step. A chunk is a row of `classes`, already times N_STATES."""
    states = np.broadcast_to(np.arange(N_STATES, dtype=np.int16), (len(classes), N_STATES))
    for column in np.ascontiguousarray(classes.T):
        states = CUTS.take(column[:, None] + states)
    return states


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Composition of all maps up to and with each row, by doubling: composing state maps is associative."""
    done, reach = maps.copy(), 1
    while reach < len(done):
        done[reach:] = np.take_along_axis(done[reach:], done[:-reach], axis=1)  # first what came before, then the later map
        reach *= 2
    return done


def word_starts(classes: np.ndarray) -> np.ndarray:
    """Boolean for each character of a text sequence that begins in state FRESH: a word (pre-token or end mark) starts here."""
    n = len(classes)
    m = -(-n // CHUNK)
    padded = np.full(m * CHUNK, END, np.int16)
    padded[:n] = classes
    padded = (padded * N_STATES).reshape(m, CHUNK)
    state = np.full(m, FRESH, np.int16)
    state[1:] = prefix_scan(chunk_maps(padded))[:-1, FRESH]
    events = np.empty((CHUNK, m), np.uint8)
    for j, column in enumerate(np.ascontiguousarray(padded.T)):
        at = column + state
        events[j], state = EVENTS.take(at), CUTS.take(at)
    events = np.ascontiguousarray(events.T).reshape(-1)[: n + 1]
    starts = (events[:n] & CUT).astype(bool)
    starts[: len(events) - 1] |= (events[1:] & CUT_BEFORE).astype(bool)
    starts[:1] = True
    return starts


class MergeMachine:
    """Byte transducer of a merge tokenizer, compiled transition by transition.

    `tokens`: bytes of each token, `merges`: (left, right, merged token) by rank. `table[state, byte]` is 16 * next state + output + 8, or
    0 where not compiled. State 0 is the empty word, to which no transition leads. The table has its full height from the start, but zeros
    that were never written take no memory, and it is never copied. Pairs are remembered by one number each (`PAIRED` * left + right).
    """

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int, int]], max_states: int = 120_000, settled: int = 40) -> None:
        self.max_states, self.settled = max_states, settled
        self.rank = {merged: k for k, (_, _, merged) in enumerate(merges)}
        self.parts = {merged: (left, right) for left, right, merged in merges}
        self.pair = {(left, right): k for k, (left, right, _) in enumerate(merges)}
        self.apart: dict[int, bool] = {}
        #: trie over the tokens that merging can reach: (node, byte) -> node; node -> token
        self.child: dict[tuple[int, int], int] = {}
        self.token: dict[int, int] = {}
        above, nodes = {}, 1
        for token, raw in tokens.items():
            if len(raw) > 1 and not (token in self.parts and self._reachable(token)):
                continue
            node = 0
            for byte in raw:
                nxt = self.child.get((node, byte))
                if nxt is None:
                    nxt = self.child[node, byte] = nodes
                    above[nxt] = node
                    nodes += 1
                node = nxt
            self.token[node] = token
        #: tokens that lie strictly below each inner node
        self.below: dict[int, list[int]] = {}
        for node, token in self.token.items():
            while node := above[node]:
                self.below.setdefault(node, []).append(token)
        self.blocked: dict[int, frozenset[int]] = {}
        #: equal sets are one object
        self.sets: dict[frozenset[int], frozenset[int]] = {}
        self.clear()

    def _reachable(self, token: int) -> bool:
        left, right = self.parts[token]
        return self._stay(left, right, self.rank[token])

    def clear(self) -> None:
        self.table = None  # given back before the new one is made
        self.table = np.zeros((self.max_states + SPARE, 256), np.int32)
        self.states: list[tuple] = [((0, frozenset(), 0),)]  # suffixes, longest first: (trie node, what stands to its left, tokens fewer there)
        self.number = {self.states[0]: 0}

    def _left(self, node: int, left: int | frozenset[int]) -> int | frozenset[int]:
        """What the state keeps of the left neighbour of an unfinished token at `node`: where at most `settled` tokens are still possible, the set of those
        that would not stay apart from it (nearly always empty, which makes many histories one state), else the neighbour itself."""
        possible = self.below[node]
        if isinstance(left, frozenset):
            return left and left.intersection(possible)
        if len(possible) > self.settled:
            return left
        known = self.blocked.get(node * PAIRED + left)
        if known is None:
            if len(self.blocked) > REMEMBERED:
                self.blocked.clear()
                self.sets.clear()
            known = frozenset([t for t in possible if not self.stay_apart(left, t)])
            known = self.blocked[node * PAIRED + left] = self.sets.setdefault(known, known)
        return known

    def stay_apart(self, a: int, b: int) -> bool:
        known = self.apart.get(a * PAIRED + b)
        if known is None:
            if len(self.apart) > REMEMBERED:
                self.apart.clear()
            known = self.apart[a * PAIRED + b] = self._stay(a, b, float("inf"))
        return known

    def _stay(self, a: int, b: int, limit: float) -> bool:
        """Whether merging the joined bytes, up to but without rank `limit`, gives a, b: undo the later of both sides' last merges again and
        again; at no time may the neighbours across the border form a pair that comes before the merge undone last (equal ranks: left first)."""
        rank, parts, pair = self.rank, self.parts, self.pair
        while True:
            across = pair.get((a, b))
            if across is not None and across < limit:
                return False
            left, right = rank.get(a, -1), rank.get(b, -1)
            if left < 0 and right < 0:
                return True
            if left > right:
                limit, a = left, parts[a][1]
            else:
                limit, b = right + 0.5, parts[b][0]

    def compile(self, state: int, byte: int) -> int:
        """Compile one transition; returns its table entry."""
        found, grown = None, []
        for node, left, fewer in self.states[state]:
            node = self.child.get((node, byte))
            if node is None:
                continue
            if found is None and (piece := self.token.get(node)) is not None:
                if piece not in left if isinstance(left, frozenset) else self.stay_apart(left, piece):
                    found, output = piece, fewer + 1
            if node in self.below:
                grown.append((node, left, fewer))
        if found is None:
            raise ValueError(f"no token for byte {byte}")
        kept = ((node, self._left(node, left), fewer - output) for node, left, fewer in grown)
        after = (*(s for s in kept if not (isinstance(s[1], frozenset) and len(s[1]) == len(self.below[s[0]]))), (0, found, 0))
        number = self.number.get(after)
        if number is None:
            number = self.number[after] = len(self.states)
            self.states.append(after)
            if number >= len(self.table):  # one step may compile more states than are spare
                self.table = np.concatenate([self.table, np.zeros((len(self.table) // 4 + 1, 256), np.int32)])
        entry = self.table[state, byte] = 16 * number + output + 8
        return int(entry)

    def count_one(self, word: bytes) -> int:
        """Tokens of one word, byte by byte; the table is emptied on the way if it fills up."""
        state = total = 0
        for byte in word:
            entry = int(self.table[state, byte])
            if not entry:
                if len(self.states) >= self.max_states:
                    chain = self.states[state]
                    self.clear()
                    if chain not in self.number:
                        self.number[chain] = 1
                        self.states.append(chain)
                    state = self.number[chain]
                entry = self.compile(state, byte)
            state, total = entry >> 4, total + (entry & 15) - 8
        return total

    def count(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each word raw[start : start + size], all words in step."""
        total = np.zeros(len(start), np.int64)
        for k in np.nonzero(size > LONG_WORD)[0]:
            total[k] = self.count_one(raw[start[k] : start[k] + size[k]].tobytes())
        short = np.nonzero((size > 0) & (size <= LONG_WORD))[0]
        if not len(short):
            return total
        if len(self.states) >= 0.8 * self.max_states:
            self.clear()
        length = size[short].astype(np.int16)
        order = np.argsort(-length, kind="stable")
        short, active = short[order], len(short) - np.cumsum(np.bincount(length, minlength=LONG_WORD + 1))
        at, state, sums = start[short], np.zeros(len(short), np.int64), np.zeros(len(short), np.int32)
        for j in range(LONG_WORD):
            n = active[j]
            if not n:
                break
            key = state[:n] * 256 + raw[at[:n] + j]
            entry = self.table.reshape(-1).take(key)
            new = np.nonzero(entry == 0)[0]
            if len(new):
                for one in np.unique(key[new]).tolist():
                    self.compile(one >> 8, one & 255)
                if len(self.states) >= self.max_states:  # so many in one part: go on word by word, which empties the table whenever it is full
                    sums[:n] = [self.count_one(raw[a : a + size[k]].tobytes()) for a, k in zip(at[:n], short[:n])]
                    break
                entry[new] = self.table.reshape(-1).take(key[new])
            state[:n] = entry >> 4
            sums[:n] += (entry & 15) - 8
        total[short] = sums
        return total


def read_model(path: str) -> tuple[dict[int, bytes], list[tuple[int, int, int]], list[str]]:
    """(bytes of each token, merges, special strings) of a byte-level merge tokenizer file; others are refused."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, cutter = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not spec["normalizer"] and not model.get("ignore_merges") and not model.get("end_of_word_suffix")
    if not plain or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
        raise ValueError("only byte-level merge models without normalisation are compiled")
    # the format's printable stand-ins: bytes that are printable Latin-1 stand for themselves, the others for 256, 257, ... in order
    own = [b for b in range(256) if chr(b).isprintable() and chr(b) != " "]
    stand = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    added = spec.get("added_tokens", [])
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("special strings that take in their surroundings are not supported")
    names, ids = {t["content"] for t in added}, model["vocab"]
    tokens = {i: bytes(stand[c] for c in t) for t, i in ids.items() if t not in names}
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return tokens, [(ids[a], ids[b], ids[a + b]) for a, b in pairs], sorted(names, key=len, reverse=True)


class TokenCounter:
    """Both machines and the special strings; one for each task."""

    def __init__(self, tokens, merges, specials: list[str], classes: np.ndarray | None = None, max_states: int = 120_000) -> None:
        self.machine = MergeMachine(tokens, merges, max_states)
        self.classes = character_classes() if classes is None else classes
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None

    def pieces(self, texts: list[str | None]):
        """(row, piece): stretches that are cut apart from their surroundings, and the number of special strings of each row."""
        owner, found, extra = [], [], np.zeros(len(texts), np.int64)
        for row, text in enumerate(texts):
            if not text:
                continue
            parts = self.special.split(text) if self.special else [text]
            extra[row] = len(parts) - 1
            for part in parts:
                at = 0
                while len(part) - at > PART and (cut := CERTAIN.search(part, at + PART)):
                    owner.append(row)
                    found.append(part[at : cut.start()])
                    at = cut.start()
                owner.append(row)
                found.append(part[at:] if at else part)
        return owner, found, extra

    def count(self, texts: list[str | None]) -> np.ndarray:
        owner, found, total = self.pieces(texts)
        at = 0
        while at < len(found):
            stop, chars = at, 0
            while stop < len(found) and (stop == at or chars + len(found[stop]) <= PART):
                chars += len(found[stop]) + 1
                stop += 1
            total += np.bincount(owner[at:stop], weights=self._count(found[at:stop]), minlength=len(total)).astype(np.int64)
            at = stop
        return total

    def _count(self, found: list[str]) -> np.ndarray:
        joined = "".join(found)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(lengths + 1) - 1  # places of the end marks
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        spread = np.full(len(points) + len(found), 0x110000, np.uint32)
        real = np.ones(len(spread), bool)
        real[ends] = False
        spread[real] = points
        width = 1 + (spread > 0x7F) + (spread > 0x7FF) + (spread > 0xFFFF).astype(np.int8)
        width[ends] = 0
        byte = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        first = np.nonzero(word_starts(self.classes.take(spread)))[0]
        start = byte[first]
        size = np.diff(np.append(start, byte[-1]))
        counts = self.machine.count(np.frombuffer(joined.encode("utf-8", "replace"), np.uint8), start, size)
        return np.bincount(np.searchsorted(ends, first), weights=counts, minlength=len(found))


_COMPILED: dict = {}


def compiled(key, make) -> TokenCounter:
    """The counter of this Python worker, kept from task to task so that transitions are compiled once a worker; one model at a time."""
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = make()
    return _COMPILED[key]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", max_states: int = 120_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit: n_tokens > `limit`) of every row of `docs`. The model file is read on the driver."""
    from tokenizers import Tokenizer

    tokens, merges, specials = read_model(model_path)
    # the closure carries ranges of equal class instead of a million codes
    classes = confirm_classes(character_classes(), Tokenizer.from_file(model_path).pre_tokenizer.pre_tokenize_str)
    edge = np.concatenate([[0], np.nonzero(np.diff(classes))[0] + 1, [len(classes)]])
    runs = classes[edge[:-1]], np.diff(edge)
    key = (zlib.crc32(repr((tokens, merges, specials)).encode()), max_states)

    def run(batches):
        counter = compiled(key, lambda: TokenCounter(tokens, merges, specials, np.repeat(*runs), max_states))
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                texts = part.column(1).to_pylist()
                n = pa.array(counter.count(texts))
                size = pa.array([len(t.encode("utf-8", "replace")) if t else 0 for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, n], names=["doc_id", "n_bytes", "n_tokens"])

    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    counted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
