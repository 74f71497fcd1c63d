"""SentencePiece encoding and decoding by shortest paths in a weighted finite-state transducer.

Compiled once on the driver from a model file, into arrays that go to the workers:

* Normaliser arcs: a space and the mark are one input symbol, and the start state writes a mark.
* Piece arcs: a trie over input symbols; its accepting states write one piece, of weight one.
* Byte arcs: an input symbol without a piece writes the pieces of its UTF-8 bytes, of weight one.
* The second automaton, over pieces: a state for each last piece; a piece has weight zero
  where it may follow, and infinity where it may not. Merging pieces by score is local, so a
  sequence is the model's own if and only if every two neighbours stay apart when their
  characters are merged. ``follows`` walks back along the two pieces' merges: neighbours
  would have been merged if a piece for both ranks before the merges that took them away.

Encoding composes both with an input and relaxes the arcs in the order of positions, in the
tropical semiring (least sum of weights), for all words of a batch at once; then it follows
the best arcs back. Of the sequences of a prefix one alone has a finite weight, so a position
keeps one last piece. No piece continues over the start of a word (checked when compiling), so
inputs are cut there and a word's path is found once as long as a worker's cache holds it.
Decoding is the inverse: a piece's id writes its characters, a byte's id its byte.

Defined results: a null text is an empty one, which has no pieces; a null id is kept;
repeated rows are encoded each; the mark character in a text is decoded as a space, as by
the library; an empty table gives an empty result; other columns are ignored, whatever
their names. Texts are taken whole, however long.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

MARK = "▁"
#: Normaliser arcs that change their character; all others write what they read.
NORMALISED = {" ": MARK}
#: Words whose paths a worker keeps in each of two generations, and the longest that go through the arrays.
CACHE, LONGEST_WORD = 400_000, 48
#: Characters of the texts that are encoded together.
TOGETHER = 3_000_000
_NEVER = np.int64(2**40)
_WORDS = re.compile(f"[ {MARK}]+[^ {MARK}]*").findall


@dataclass
class Transducer:
    """Arrays over pieces (their numbers), trie states and input symbols; symbol 0 is any character without a piece.

    chars, symbol: input characters, in order, and their symbols. arcs, target: trie arcs (state * symbols + symbol), in
    order. accepts: the piece of a state, or -1. ids, size: id and characters of a piece. rank, left, right: when a
    piece is merged, and of what (-1: a single character). pairs, pair_rank: two pieces (left * pieces + right), in
    order, that make a third, and its rank. runs, marked: whether a piece is marks alone, begins with one. byte_ids: the
    id of each byte's piece.
    """

    texts: list
    chars: np.ndarray
    symbol: np.ndarray
    arcs: np.ndarray
    target: np.ndarray
    accepts: np.ndarray
    ids: np.ndarray
    size: np.ndarray
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pairs: np.ndarray
    pair_rank: np.ndarray
    runs: np.ndarray
    marked: np.ndarray
    byte_ids: list
    known: dict = field(default_factory=dict, repr=False)
    older: dict = field(default_factory=dict, repr=False)
    apart: dict = field(default_factory=dict, repr=False)
    scalar: tuple | None = field(default=None, repr=False)

    @property
    def fallback(self) -> int:
        """The number that stands for the byte arc."""
        return len(self.ids)

    def symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Code points and symbols."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        return points, np.where(self.chars[at] == points, self.symbol[at], 0)

    def _stays_apart(self, a: int, b: int) -> bool:
        """By merging the two pieces' characters; for runs of marks, whose merges all have one rank."""
        key = (a, b)
        if (found := self.apart.get(key)) is None:
            if self.scalar is None:
                self.scalar = self._as_dicts()
            number = self.scalar[0]
            parts = list(self.texts[a] + self.texts[b])
            while True:
                best, at = None, 0
                for i in range(len(parts) - 1):
                    p = number.get(parts[i] + parts[i + 1])
                    if p is not None and (best is None or self.rank[p] < best):
                        best, at = self.rank[p], i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.apart[key] = found = parts == [self.texts[a], self.texts[b]]
        return found

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may follow piece a (-1: the start). Byte arcs may follow and be followed by anything."""
        n = self.fallback
        ok = np.ones(len(a), bool)
        real = (a >= 0) & (a < n) & (b < n)
        marks = np.flatnonzero(real & self.runs[np.where(real, a, 0)] & self.marked[np.where(real, b, 0)])
        for k in marks.tolist():
            ok[k] = self._stays_apart(int(a[k]), int(b[k]))
        real[marks] = False
        todo = np.flatnonzero(real)
        x, y, limit = a[todo], b[todo], np.full(len(todo), _NEVER)
        while len(todo):
            key = x * n + y
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            merged = (self.pairs[at] == key) & (self.pair_rank[at] < limit)
            ok[todo[merged]] = False
            rx, ry = self.rank[x], self.rank[y]
            more = ~merged & ((rx >= 0) | (ry >= 0))
            todo, x, y, rx, ry = todo[more], x[more], y[more], rx[more], ry[more]
            # the later of the two merges is undone; of equal ranks the right one came later, and a merge across it goes first
            at_x = rx > ry
            limit = np.where(at_x, rx, ry + 1)
            x, y = np.where(at_x, self.right[x], x), np.where(at_x, y, self.left[y])
        return ok

    def paths(self, words: list[str]) -> list[bytes]:
        """The shortest path's output for each word: ids as little-endian unsigned 32-bit bytes. Words of LONGEST_WORD at most."""
        if not words:
            return []
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))
        points, symbol = self.symbols("".join([words[k] for k in order]))
        length = np.array([len(words[k]) for k in order])
        begin = np.cumsum(length) - length  # of a word's characters; its positions are one more
        place = begin + np.arange(len(words))
        weight = np.full(len(points) + len(words), _NEVER)
        last = np.full(len(points) + len(words), -1, np.int64)
        weight[place] = 0
        width = np.int64(self.symbol.max() + 1)
        for i in range(int(length[0])):
            live = np.arange(int(np.searchsorted(-length, -i)))  # words of more than i characters
            state = np.zeros(len(live), np.int64)
            for step in range(1, int(self.size.max()) + 1):
                inside = length[live] >= i + step
                live, state = live[inside], state[inside]
                if not len(live):
                    break
                s = symbol[begin[live] + i + step - 1]
                if step == 1 and not s.all():
                    self._relax(weight, last, place[live[s == 0]] + i, 1, np.full(int((s == 0).sum()), self.fallback))
                key = state * width + s
                at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
                there = (self.arcs[at] == key) & (s > 0)
                live, state = live[there], self.target[at[there]]
                piece = self.accepts[state]
                ends = piece >= 0
                self._relax(weight, last, place[live[ends]] + i, step, piece[ends])
        # back along the best arcs, all words at once
        word, at = np.arange(len(words)), length.copy()
        size = np.append(self.size, 1)
        found: list[tuple] = []
        while len(word):
            piece = last[place[word] + at]
            at = at - size[piece]
            found.append((word, piece, begin[word] + at))
            more = at > 0
            word, at = word[more], at[more]
        step = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        word, piece, where = (np.concatenate([f[k] for f in found]) for k in range(3))
        sort = np.lexsort((-step, word))
        word, piece, where = word[sort], piece[sort], where[sort]
        ids = np.append(self.ids, 0)[piece].astype("<u4")
        bytes_ = np.flatnonzero(piece == self.fallback)
        if len(bytes_):
            written = [self.bytes_of(chr(points[k])) for k in where[bytes_].tolist()]
            many = np.ones(len(ids), np.int64)
            many[bytes_] = [len(w) for w in written]
            first = np.cumsum(many) - many
            ids, word = np.repeat(ids, many), np.repeat(word, many)
            for k, w in zip(first[bytes_].tolist(), written, strict=True):
                ids[k : k + len(w)] = w
        whole = ids.tobytes()
        ends = (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        out = [b""] * len(words)
        for k, a, b in zip(order, [0, *ends[:-1]], ends, strict=True):
            out[k] = whole[a:b]
        return out

    def _relax(self, weight: np.ndarray, last: np.ndarray, at: np.ndarray, step: int, piece: np.ndarray) -> None:
        """Arcs from positions over ``step`` characters that write these pieces: keep what is lighter than what is known."""
        total = weight[at] + np.where(self.follows(last[at], piece), 1, _NEVER)
        to = at + step
        lighter = total < np.minimum(weight[to], _NEVER)
        weight[to[lighter]] = total[lighter]
        last[to[lighter]] = piece[lighter]

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def _as_dicts(self) -> tuple[dict, dict]:
        return {t: k for k, t in enumerate(self.texts)}, dict(zip(self.pairs.tolist(), self.pair_rank.tolist(), strict=True))

    def long_path(self, word: str) -> bytes:
        """The same for one word of any length, arc by arc."""
        if self.scalar is None:
            self.scalar = self._as_dicts()
        number = self.scalar[0]
        text = "".join([NORMALISED.get(c, c) for c in word])
        n, longest = len(text), int(self.size.max())
        last: list[int] = [-1] * (n + 1)
        memo: dict[tuple[int, int], bool] = {}
        for i in range(n):
            for j in range(i + 1, min(n, i + longest) + 1):
                if last[j] >= 0:
                    continue
                piece = number.get(text[i:j], self.fallback if j == i + 1 else -1)
                if piece < 0:
                    continue
                key = (last[i], piece)
                if (may := memo.get(key)) is None:
                    memo[key] = may = bool(self.follows(np.array([last[i]]), np.array([piece]))[0])
                if may:
                    last[j] = piece
        parts, at = [], n
        while at:
            piece = last[at]
            at -= 1 if piece == self.fallback else int(self.size[piece])
            parts.append(self.bytes_of(text[at]) if piece == self.fallback else [int(self.ids[piece])])
        return np.array(list(chain.from_iterable(reversed(parts))), "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit bytes."""
        out, at = [], 0
        while at < len(texts):
            some, chars = [], 0
            while at < len(texts) and (not some or chars < TOGETHER):
                some.append(_WORDS(" " + texts[at]) if texts[at] else [])
                chars += len(texts[at])
                at += 1
            missing = list(set(chain.from_iterable(some)).difference(self.known))
            older = self.older
            self.known.update((w, older[w]) for w in missing if w in older)
            new = [w for w in missing if w not in older]
            short = [w for w in new if len(w) <= LONGEST_WORD]
            self.known.update(zip(short, self.paths(short), strict=True))
            long = {w: self.long_path(w) for w in new if len(w) > LONGEST_WORD}
            self.known.update(long)
            ids_of = self.known.__getitem__
            out += [b"".join(map(ids_of, words)) for words in some]
            for w in long:
                del self.known[w]
            if len(self.known) > CACHE:
                self.older, self.known = self.known, {}
        return out

    def decoder(self) -> list[bytes]:
        """Output of each id in the inverse transducer; control and unknown pieces have none."""
        out = [b""] * (max(int(self.ids.max()), *self.byte_ids) + 1)
        for text, i in zip(self.texts, self.ids.tolist(), strict=True):
            out[i] = text.replace(MARK, " ").encode()
        for value, i in enumerate(self.byte_ids):
            out[i] = bytes([value])
        return out


def compiled(path: str) -> Transducer:
    """From a BPE model with byte fallback and the identity normaliser with a mark in front; other models are refused."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    spec, trainer = model.normalizer_spec, model.trainer_spec
    if spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces or trainer.model_type != trainer.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
        raise ValueError("not a byte-fallback BPE model with the identity normaliser: " + path)
    kind = model.SentencePiece
    normal = [(p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type == kind.NORMAL]
    if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces) or any(MARK in p.lstrip(MARK) for p, _, _ in normal):
        raise ValueError("pieces that go over the start of a word, or are defined by users: " + path)
    byte_at = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
    return compile_pieces(normal, [byte_at[b] for b in range(256)])


def compile_pieces(normal: list[tuple[str, int, float]], byte_ids: list[int]) -> Transducer:
    """From (text, id, score) of the pieces."""
    by_score = {s: k for k, s in enumerate(sorted({s for _, _, s in normal}, reverse=True))}
    score = {t: by_score[s] for t, _, s in normal}

    def last_merge(text: str) -> tuple[str, str] | None:
        """The two parts that merging a piece's characters puts together last; None if it never comes to the piece."""
        parts, done = list(text), None
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = score.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return None
            done = (parts[at], parts[at + 1])
            parts[at : at + 2] = [done[0] + done[1]]
        return done

    merges = {t: last_merge(t) for t, _, _ in normal if len(t) > 1}
    pieces = [(t, i) for t, i, _ in normal if len(t) == 1 or merges[t]]
    texts = [t for t, _ in pieces]
    number = {t: k for k, t in enumerate(texts)}
    for t, parts in merges.items():
        if parts and (any(p not in number for p in parts) or any(len(p) > 1 and score[p] > score[t] for p in parts)):
            raise ValueError(f"piece {t!r} is merged before its parts")
    rank = np.array([score[t] if len(t) > 1 else -1 for t in texts], np.int64)
    left, right = (np.array([number[merges[t][k]] if len(t) > 1 else -1 for t in texts], np.int64) for k in (0, 1))
    letters = sorted({c for t in texts for c in t})
    symbol_of = {c: k + 1 for k, c in enumerate(letters)}
    symbol_of |= {c: symbol_of[n] for c, n in NORMALISED.items() if n in symbol_of}
    inputs = sorted(symbol_of)
    width, trie, accepts = len(letters) + 1, {}, [-1]
    for k, t in enumerate(texts):
        state = 0
        for c in t:
            key = state * width + symbol_of[c]
            if key not in trie:
                trie[key] = len(accepts)
                accepts.append(-1)
            state = trie[key]
        accepts[state] = k
    arcs = sorted(trie)
    pairs = {number[t[:c]] * len(texts) + number[t[c:]]: score[t] for t in texts for c in range(1, len(t)) if t[:c] in number and t[c:] in number}
    keys = sorted(pairs)
    long = lambda values: np.array(values, np.int64)
    return Transducer(
        texts, np.array([ord(c) for c in inputs], np.uint32), long([symbol_of[c] for c in inputs]), long(arcs), long([trie[a] for a in arcs]), long(accepts),
        long([i for _, i in pieces]), long([len(t) for t in texts]), rank, left, right, long(keys), long([pairs[k] for k in keys]), np.array([not t.strip(MARK) for t in texts]), np.array([t[0] == MARK for t in texts]), byte_ids,
    )


def decode(ids, outputs: list[bytes]) -> str:
    """The text of ids; the mark in front goes, broken UTF-8 becomes replacement characters."""
    return b"".join(map(outputs.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def _rows(transducer: Transducer, full: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outputs = transducer.decoder()
        for batch in batches:
            columns: list[list] = [[] for _ in range(4)]
            texts = batch.column(1).to_pylist()
            for given, ids in zip(texts, transducer.encode(texts), strict=True):
                numbers = memoryview(ids).cast("I")
                back = decode(numbers, outputs)
                values = (numbers if full else len(numbers), zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == given.replace(MARK, " "))
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            types = (pa.list_(pa.int64()) if full else pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "ids" if full else "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    return run


def encoded(docs: DataFrame, model: str, full: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (or only n_tokens), ids_crc32 (little-endian unsigned 32-bit), decoded_sha256, round_trip."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    first = "ids array<long>" if full else "n_tokens long"
    return texts.mapInArrow(_rows(compiled(model), full), f"doc_id long, {first}, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def decoded(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of ids; null ids give an empty text, ids that the model lacks are an error."""
    outputs = compiled(model).decoder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(ids or (), outputs) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<long>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), full=False)
