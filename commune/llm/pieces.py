"""SentencePiece encoding and decoding by shared-prefix Viterbi over distinct marked words.

A text is marked (a space goes in front; a space is the mark that the model writes as U+2581)
and cut into marked words: runs of the mark with the characters up to the next mark. No piece joins a character to a mark after
it, so words are encoded apart. The distinct words of a batch are sorted, which is the
depth-first order of their trie, and a forward table over prefix lengths is kept: for the next
word only the entries beyond the common prefix with the word before are computed.

Forward scores. The available model is a BPE model. Its merges aren't the path of highest summed
score, so a transition is scored 0 if the pair (piece before, piece) is stable, that is if merging
the pair's text gives exactly the two pieces, and minus infinity otherwise. Every prefix then has
exactly one path of finite score, and it is the model's own encoding (the tests compare it with
the reference library). Characters without a piece become the pieces of their UTF-8 bytes.

Defined results: a null text is an empty one, an empty text has no pieces. U+2581 in a text is
read as a space, as in the original library. Decoding joins pieces and bytes (invalid UTF-8
becomes U+FFFD) and removes the space in front. Repeated rows are encoded alike. The model file
travels with the tasks; its path is a parameter. What a worker remembers is bounded in bytes.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commune.llm.common import char_slices, give_back, table, text_or_empty

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: What a worker remembers between slices of its rows, in bytes: encoded words in each of two
#: generations, and the pairs and ends of prefixes met. A word beyond ``LONGEST_KEPT`` characters is
#: encoded whole like any other but not remembered.
KEPT_BYTES, LONGEST_KEPT = 32 << 20, 64
#: Bytes of the pairs, which all words share and which cost most to find again.
KEPT_PAIR_BYTES = 64 << 20
#: Characters of the rows that are encoded together.
SLICE = 1_000_000
#: Bytes of a dictionary's own entry, about.
_ENTRY = 100
_WORDS = re.compile(" +[^ ]*")


@dataclass(frozen=True)
class Vocabulary:
    """What encoding and decoding need of a model file."""

    ids: dict  # piece, marks as spaces -> id, without control, unknown and byte pieces
    scores: dict  # piece -> score
    byte_ids: tuple
    decoded: tuple  # id -> bytes, marks as spaces
    longest: int


def load_vocabulary(path: str = MODEL_PATH) -> Vocabulary:
    return read_vocabulary(_model(path))


def _model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def read_vocabulary(model: bytes) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    ids, scores, byte_ids, decoded = {}, {}, [0] * 256, []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            decoded.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unused(i):
            decoded.append(b"")
        elif sp.is_unknown(i):
            decoded.append(" ⁇ ".encode())
        else:
            piece = piece.replace(MARK, " ")
            ids[piece], scores[piece] = i, sp.get_score(i)
            decoded.append(piece.encode())
    return Vocabulary(ids, scores, tuple(byte_ids), tuple(decoded), max(map(len, ids)))


class Encoder:
    """Encodes runs of texts; keeps words and pairs it has seen, each within ``kept_bytes``."""

    def __init__(self, vocabulary: Vocabulary, kept_bytes: int = KEPT_BYTES, kept_pair_bytes: int = KEPT_PAIR_BYTES):
        self.v, self.kept_bytes, self.kept_pair_bytes = vocabulary, kept_bytes, kept_pair_bytes
        self.words_held = self.pairs_held = self.ends_held = 0
        #: Encoded words; those of the generation before move up when they are met again.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: (piece before, piece) -> whether merging their text gives exactly the two.
        self.pairs: dict[tuple[str, str], bool] = {}
        #: End of a prefix -> sizes of pieces that may end there, longest first.
        self.ends: dict[str, tuple[int, ...]] = {}
        self.by_end: dict[str, set[int]] = {}
        for piece in vocabulary.ids:
            self.by_end.setdefault(piece[-3:], set()).add(len(piece))
        self.packed = {p: i.to_bytes(4, "little") for p, i in vocabulary.ids.items()}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best-scored, then leftmost, pair."""
        parts, scores = list(text), self.v.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def stable(self, before: str, piece: str) -> bool:
        if self.pairs_held > self.kept_pair_bytes:
            self.pairs.clear()
            self.pairs_held = 0
        self.pairs_held += 3 * _ENTRY + len(before) + len(piece)
        ok = self.pairs[before, piece] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return ok

    def _sizes(self, end: str) -> tuple[int, ...]:
        if self.ends_held > self.kept_bytes:
            self.ends.clear()
            self.ends_held = 0
        self.ends_held += 3 * _ENTRY
        sizes = {n for k in range(len(end)) for n in self.by_end.get(end[k:], ()) if k == 0 or n == len(end) - k}
        self.ends[end] = found = tuple(sorted(sizes | {1}, reverse=True))
        return found

    def segment(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, pieces) of sorted words: a depth-first walk that shares the forward table."""
        ids, ends, pairs, stable, sizes = self.v.ids, self.ends, self.pairs, self.stable, self._sizes
        last = [""]  # last[i]: the last piece of the encoding of the prefix of length i
        shown = ""
        for word in words:
            common = min(len(shown), len(word))
            while word[:common] != shown[:common]:
                common -= 1
            del last[common + 1:]
            for i in range(common + 1, len(word) + 1):
                end = word[i - 3 if i > 3 else 0:i]
                for size in ends.get(end) or sizes(end):
                    if size <= i:
                        piece = word[i - size:i]
                        if piece in ids or size == 1:
                            before = last[i - size]
                            ok = pairs.get((before, piece))
                            if ok or ok is None and stable(before, piece):
                                last.append(piece)
                                break
                else:
                    raise AssertionError(f"no path to {word[:i]!r}")
            shown = word
            pieces, i = [], len(word)
            while i:
                piece = last[i]
                pieces.append(piece)
                i -= len(piece)
            pieces.reverse()
            yield word, pieces

    def _ids(self, pieces: list[str]) -> bytes:
        packed = self.packed
        try:
            return b"".join([packed[p] for p in pieces])
        except KeyError:
            return b"".join([packed[p] if p in packed else b"".join(
                [self.v.byte_ids[b].to_bytes(4, "little") for b in p.encode("utf-8", "surrogatepass")]) for p in pieces])

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The piece ids of each text as little-endian 32-bit integers."""
        cut, fresh = [], set()
        if self.words_held > self.kept_bytes:
            self.older, self.known, self.words_held = self.known, {}, 0
        known, older, size = self.known, self.older, sys.getsizeof
        for t in texts:
            if MARK in t:
                t = t.replace(MARK, " ")
            if not t:
                words = []
            elif "  " in t or t[0] == " ":
                words = [w[1:] for w in _WORDS.findall(" " + t)]
            else:
                words = t.split(" ")
            cut.append(words)
            fresh.update(words)
        fresh.difference_update(known)
        known.update((w, older[w]) for w in fresh if w in older)
        # Words are kept without their first mark.
        for word, pieces in self.segment(" " + w for w in sorted(fresh.difference(older))):
            known[word[1:]] = self._ids(pieces)
        made = [b"".join([known[w] for w in words]) for words in cut]
        for w in fresh:
            if len(w) > LONGEST_KEPT:
                del known[w]
            else:
                self.words_held += size(w) + size(known[w]) + _ENTRY
        return made


def decode(ids: Iterable[int], vocabulary: Vocabulary) -> str:
    table_ = vocabulary.decoded
    text = b"".join([table_[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


_ENCODERS: dict[bytes, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    """One encoder per worker process and model: later tasks meet words that earlier ones encoded.

    Tasks carry the model file, not the tables made of it, which a worker makes once.
    """
    if model not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[model] = Encoder(read_vocabulary(model))
    return _ENCODERS[model]


def encode_column(text: Column, path: str = MODEL_PATH) -> Column:
    """The piece ids of a text, array<int>."""
    model = _model(path)

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _encoder(model)
        for b in batches:
            for s in char_slices(b, SLICE):
                yield pd.Series([np.frombuffer(x, "<i4") for x in e.encode(s)], dtype=object)
        give_back()

    return encoded(text_or_empty(text))


def decode_column(ids: Column, path: str = MODEL_PATH) -> Column:
    """The text of piece ids; null ids give an empty text."""
    model = _model(path)

    @F.pandas_udf("string")
    def decoded(b: pd.Series) -> pd.Series:
        known = _encoder(model).v
        return pd.Series([decode([] if x is None else x.tolist(), known) for x in b], dtype=object)

    return decoded(ids)


def digest_column(text: Column, path: str = MODEL_PATH) -> Column:
    """struct<n_pieces, ids_sha256, decoded_sha256, round_trip> of encoding and decoding a text.

    ids_sha256 is over the ids as little-endian 32-bit integers.
    """
    model = _model(path)

    @F.pandas_udf("n_pieces bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = _encoder(model)
        for b in batches:
            for s in char_slices(b, SLICE):
                out = []
                for t, x in zip(s, e.encode(s)):
                    back = decode(np.frombuffer(x, "<i4").tolist(), e.v)
                    out.append((len(x) // 4, hashlib.sha256(x).hexdigest(),
                                hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == t))
                yield pd.DataFrame(out, columns=["n_pieces", "ids_sha256", "decoded_sha256", "round_trip"])
        give_back()

    return digests(text_or_empty(text))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", digest_column(F.col("text")).alias("d")).select("doc_id", "d.*")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids) of every document."""
    made = docs.select("doc_id", encode_column(F.col("text")).alias("ids"))
    return made.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids")
