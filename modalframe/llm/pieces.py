"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is marked as the model says (a leading mark, spaces become marks) and cut into marked words: marks, then other characters.
No piece crosses such a cut, so words are segmented alone. The distinct words of a batch are sorted, which lays them out as
a depth-first walk of their trie; the forward states of the prefix a word shares with the word before are kept, and only
the rest is computed. The forward state at a position depends on the prefix alone:

- unigram models: the best total score and its last piece (unknown characters score 10 below the worst piece);
- merge (BPE) models: a path is allowed when every two adjacent pieces stay apart if merged alone, which leaves exactly one
  path, the one that merging yields. The state is that path's last piece, so ids equal those of step-by-step merging.

Characters without a piece become byte pieces, or the unknown id if the model has none. Work is local to a task: documents
are neither shuffled nor joined, and the memo of words is bounded by two generations of `memo` entries.

Nulls: a null text counts as empty and has no ids. A literal mark character U+2581 is read as a space, as the format does, so such a
text does not return unchanged; neither does one with a character that has no piece in a model without byte pieces. Very long texts
are encoded word by word like others; runs of spaces are merged by a queue. Repeated rows give repeated results, an empty table an empty one.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

MARK = "▁"
MARKED_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
UNKNOWN_COST = 10.0
TAIL = 4


@lru_cache(maxsize=4)
def load_pieces(path: str) -> "Pieces":
    """Read a model file (on the driver; tasks get its table)."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
        raise ValueError("only models with identity normalisation are supported")
    rows = [(p.piece, p.score, p.type) for p in model.pieces]
    return Pieces(rows, model.trainer_spec.model_type == 2, spec.add_dummy_prefix)


class Pieces:
    """A piece table: `rows` are (piece, score, type), type 1 normal, 2 unknown, 3 control, 6 byte."""

    def __init__(self, rows: list[tuple[str, float, int]], merges: bool, prefix: bool = True) -> None:
        self.merges, self.prefix = merges, prefix
        self.ids = {p: i for i, (p, _, kind) in enumerate(rows) if kind in (1, 4)}
        self.score = [s for _, s, _ in rows]
        self.byte_id = {int(p[3:-1], 16): i for i, (p, _, kind) in enumerate(rows) if kind == 6}
        self.unknown = next((i for i, r in enumerate(rows) if r[2] == 2), 0)
        self.raw = [bytes([int(p[3:-1], 16)]) if kind == 6 else p.replace(MARK, " ").encode() if kind in (1, 4) else b" \xe2\x81\x87 " if kind == 2 else b"" for p, _, kind in rows]
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses a word mark")
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.flat: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        if merges:
            for piece, i in list(self.ids.items()):
                self.parts[i] = None if len(piece) == 1 else self._last_merge(piece)
        self.reachable = {p: i for p, i in self.ids.items() if not merges or len(p) == 1 or self.parts[i]}
        self.longest = max(map(len, self.reachable), default=1)
        self.text = {i: p for p, i in self.reachable.items()}
        self.rank = {i: -1.0 if len(p) == 1 else -self.score[i] for p, i in self.reachable.items()}
        tails: dict[str, set[int]] = {}
        for p in self.reachable:
            if len(p) > TAIL:
                tails.setdefault(p[-TAIL:], set()).add(len(p))
        #: by the last characters: lengths of the pieces that end with them and are longer
        self.longer = {tail: sorted(found, reverse=True) for tail, found in tails.items()}
        self.endings: dict[str, tuple[tuple[int, int | None], ...]] = {}
        kept = [s for _, s, kind in rows if kind == 1]
        self.unknown_score = (min(kept) if kept else 0.0) - UNKNOWN_COST

    def merge(self, word: str) -> list[str]:
        """Step-by-step merging: the best-scored adjacent pair first, leftmost on ties."""
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str]] = []  # candidates by score, then place; stale ones are known by their text

        def offer(k):
            if k >= 0 and after[k] < len(parts):
                joined = parts[k] + parts[after[k]]
                if joined in self.ids:
                    heappush(queue, (-self.score[self.ids[joined]], k, joined))

        for k in range(len(parts) - 1):
            offer(k)
        while queue:
            _, k, joined = heappop(queue)
            if parts[k] is None or after[k] >= len(parts) or parts[k] + parts[after[k]] != joined:
                continue
            gone = after[k]
            parts[k], parts[gone], after[k] = joined, None, after[gone]
            if after[k] < len(parts):
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [p for p in parts if p is not None]

    def _last_merge(self, piece: str) -> tuple[int, int] | None:
        parts = list(piece)
        while len(parts) > 2:
            best = None
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best[0]):
                    best = (self.score[i], k)
            if best is None:
                return None
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        left, right = self.ids.get(parts[0]), self.ids.get(parts[1])
        return None if left is None or right is None else (left, right)

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the two pieces' text alone gives back exactly these two pieces.

        Undo the later of the two pieces' merges, again and again: at no stage may the neighbours across the cut form a piece that would
        have been merged before the one just undone (on a tie the left one goes first).
        """
        known = self.apart.get((a, b))
        if known is not None:
            return known
        pair, limit, known = (a, b), float("inf"), True
        while True:
            across = self.ids.get(self.text[a] + self.text[b])
            if across is not None and -self.score[across] < limit:
                known = False
                break
            left, right = self.rank[a], self.rank[b]
            if left > right:
                limit, a = left, self.parts[a][1]
            elif right < 0:  # two single characters
                break
            else:
                limit, b = right + 0.5, self.parts[b][0]
        if len(self.apart) > 400_000:
            self.apart.clear()
        self.apart[pair] = known
        return known

    def _bytes(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.encode()] if self.byte_id else [self.unknown]

    def segment(self, words: list[str]) -> dict[str, bytes]:
        """Ids (32-bit, as bytes) of each distinct word: one depth-first walk over the sorted words, sharing forward states of prefixes."""
        walk = self._merge_states if self.merges else self._score_states
        out, before, states = {}, "", [None]
        for word in sorted(set(words)):
            if self.merges and word.startswith(MARK * 2):  # runs of marks may have equal scores, where order decides
                ids = [i for part in self.merge(word) for i in ([self.ids[part]] if part in self.ids else self._bytes(part))]
                out[word] = array("i", ids).tobytes()
                continue
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :]
            walk(word, states)
            ids, j = [], len(word)
            while j:
                i, piece = states[j][0], states[j][1]
                ids += self._bytes(word[i:j])[::-1] if piece < 0 else [piece]
                j = i
            if not self.byte_id:  # neighbouring unknown characters are one unknown
                ids = [p for k, p in enumerate(ids) if not (p == self.unknown and k and ids[k - 1] == p)]
            out[word] = array("i", ids[::-1]).tobytes()
            before = word
        return out

    def _score_states(self, word: str, states: list) -> None:
        """state: (start of the last piece, the piece or -1, total score)"""
        get, score = self.reachable.get, self.score
        for j in range(len(states), len(word) + 1):
            best = None
            for i in range(max(0, j - self.longest), j):
                piece = get(word[i:j])
                if piece is None:
                    if j - i > 1:
                        continue
                    piece, worth = -1, self.unknown_score
                else:
                    worth = score[piece]
                worth += states[i][2] if i else 0.0
                if best is None or worth > best[2]:
                    best = (i, piece, worth)
            states.append(best)

    def _ending(self, tail: str) -> tuple[tuple[int, int | None], ...]:
        """(length, piece) of what may end a text with this ending, long ones first; the piece is None where more of the text must be looked at."""
        found = [(size, None) for size in self.longer.get(tail, ())]
        found += [(size, self.reachable[tail[-size:]]) for size in range(len(tail), 0, -1) if tail[-size:] in self.reachable]
        if len(self.endings) > 100_000:
            self.endings.clear()
        self.endings[tail] = tuple(found)
        return self.endings[tail]

    def _merge_states(self, word: str, states: list) -> None:
        """state: (start of the last piece, the piece or -1)"""
        get, apart, known, endings = self.reachable.get, self.stay_apart, self.apart.get, self.endings.get
        for j in range(len(states), len(word) + 1):
            tail = word[j - TAIL if j > TAIL else 0 : j]
            ending = endings(tail)
            for size, piece in self._ending(tail) if ending is None else ending:
                i = j - size
                if piece is None and (i < 0 or (piece := get(word[i:j])) is None):
                    continue
                if i == 0 or (last := states[i][1]) < 0:
                    break
                ok = known((last, piece))
                if ok if ok is not None else apart(last, piece):
                    break
            else:
                i, piece = j - 1, -1
            states.append((i, piece))

    def marked_words(self, text: str) -> list[str]:
        if not text:
            return []
        if self.prefix and "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return [MARK + w for w in text.split(" ")]
        return MARKED_WORD.findall((MARK if self.prefix else "") + text.replace(" ", MARK))

    def decoded_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids end to end, and where each id's bytes end."""
        if self.flat is None:
            size = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
            self.flat = np.frombuffer(b"".join(self.raw), np.uint8), np.cumsum(size) - size, size
        flat, start, size = self.flat
        sizes = size[ids]
        ends = np.cumsum(sizes)
        return flat[np.repeat(start[ids] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))], ends

    def returns(self, ids: np.ndarray, counts: list[int], texts: list[str]) -> list[bool]:
        """Whether each text equals its decoded ids, all compared as bytes in one gather."""
        raw, ends = self.decoded_bytes(ids)
        line, ends = raw.tobytes(), np.concatenate([[0], ends])
        edges = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
        out = []
        for a, b, text in zip(edges, edges[1:], texts):
            a += self.prefix and line[a : min(a + 1, b)] == b" "
            out.append(line[a:b] == text.encode("utf-8", "surrogatepass"))
        return out

    def decode(self, ids) -> str:
        """The text of a sequence of ids; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


class WordMemo:
    """Ids of words in two generations of at most `memo` words each (or those of one part). A full one becomes the older, from which words that come
    again are taken over, so that only words not met for long are segmented anew."""

    def __init__(self, pieces: Pieces, memo: int) -> None:
        self.pieces, self.memo = pieces, memo
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def covering(self, split: list[list[str]]) -> dict[str, bytes]:
        """A memo that has all words of `split`."""
        fresh = set().union(*split).difference(self.known)
        if len(self.known) + len(fresh) > self.memo:
            self.older, self.known = self.known, {}
            fresh = set().union(*split)
        again = fresh.intersection(self.older)
        self.known.update((word, self.older[word]) for word in again)
        self.known |= self.pieces.segment(list(fresh.difference(again)))
        return self.known


def encode_texts(docs: DataFrame, model_path: str, text_col: str = "text", memo: int = 200_000, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (default all), then ids array<int>, n_ids long, round_trip boolean (decoding gives the text back).

    A column of `docs` that is already named like one of the three is replaced.
    """
    pieces = load_pieces(model_path)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "n_ids", "round_trip")]
    source = docs.select(*(docs[c] for c in names), docs[text_col].alias("_text"))
    schema = StructType([docs.schema[c] for c in names] + [StructField("ids", ArrayType(IntegerType())), StructField("n_ids", LongType()), StructField("round_trip", BooleanType())])

    def run(batches):
        memo_of = WordMemo(pieces, memo)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                texts = [t or "" for t in part.column(len(names)).to_pylist()]
                split = [pieces.marked_words(t) for t in texts]
                known = memo_of.covering(split)
                parts = [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in split]
                sizes, flat = [len(x) for x in parts], np.concatenate(parts)
                same = pieces.returns(flat, sizes, texts)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                counts = pa.array(np.diff(offsets), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], ids, counts, pa.array(same, pa.bool_())], names=[*names, "ids", "n_ids", "round_trip"])

    return source.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, model_path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """`encoded` with the decoded text as column `out` (null ids give a null text)."""
    pieces = load_pieces(model_path)

    @F.pandas_udf("string")
    def run(column):
        return column.map(lambda ids: None if ids is None else pieces.decode(ids))

    return encoded.withColumn(out, run(F.col(ids_col)))
