"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of bytes exactly one vocabulary token can be the
last token of that prefix's encoding.  :class:`PrefixTable` stores that token
per prefix, so appending bytes only adds entries, and an edit only recomputes
entries until they agree with the old ones again.  Whole texts are cut into
pieces by the pre-tokenisation pattern first; pieces never influence each other.

Whether token ``b`` can follow token ``a`` is decided by replaying the merges on
both sides of their border: the right edge of ``a`` and the left edge of ``b``
grow through a chain of smaller tokens, each alive until the merge that forms
the next one.  The border falls if some pair that is alive at the same time
would merge before either of its members is merged elsewhere.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from math import inf
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches

#: Pieces kept per worker before the cache starts anew, and the longest kept.
CACHE_PIECES, CACHE_BYTES = 200_000, 256
#: Pairs of tokens kept per worker, and the bits of a token in their key.
BORDERS, SHIFT = 600_000, 24


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a tiktoken file: base64 token and rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Vocabulary:
    """Tokens with their merge history, worked out on demand."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"a byte-level vocabulary needs all 256 bytes; {len(missing)} are missing")
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self._edges: dict[int, tuple | None] = {}
        self.lengths = [len(t) for t in self.tokens]
        self.borders: dict[int, bool] = {}  # by both tokens

    def _history(self, data: bytes) -> tuple[bytes, bytes] | None:
        """The last merge of ``data`` on its own; None if merging doesn't give one token."""
        parts, last = [data[i : i + 1] for i in range(len(data))], None
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], inf), i) for i in range(len(parts) - 1))
            if rank == inf:
                return None
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return last

    def edges(self, token: int) -> tuple[list, list] | None:
        """Chains of (bytes, rank of the merge that ends it) at the token's right and left edge.

        Each chain runs from a single byte to the token itself; None for a token
        that merging never makes (it is only used as a whole piece).
        """
        if token not in self._edges:
            data = self.tokens[token]
            if len(data) == 1:
                self._edges[token] = ([(data, inf)], [(data, inf)])
            elif (last := self._history(data)) is None:
                self._edges[token] = None
            else:
                right = self.edges(self.ranks[last[1]])[0]
                left = self.edges(self.ranks[last[0]])[1]
                self._edges[token] = tuple([*chain[:-1], (chain[-1][0], token), (data, inf)] for chain in (right, left))
        return self._edges[token]

    def follows(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of ``a`` and ``b`` is these two tokens."""
        pair = a << SHIFT | b
        known = self.borders.get(pair)
        if known is None:
            if len(self.borders) > BORDERS:
                self.borders.clear()
            one, two = self.edges(a), self.edges(b)
            known = self.borders[pair] = two is not None and self._border_holds(one[0], two[1])
        return known

    def _border_holds(self, left: list, right: list) -> bool:
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.ranks.get(x + y)
            # of merges of one rank the leftmost goes first
            if rank is not None and rank < x_ends and rank <= y_ends:
                return False
            if x_ends == inf and y_ends == inf:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return PrefixTable(self, piece).ids() if piece else []

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


class PrefixTable:
    """The last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, data, [-1] * len(data)
        if data:
            self._fill(0, len(data))

    def append(self, more: bytes) -> None:
        """Add bytes at the end; earlier entries stay as they are."""
        start = len(self.data)
        self.data += more
        self.last += [-1] * len(more)
        self._fill(start, len(self.data))

    def _fill(self, start: int, end: int) -> None:
        v, last = self.vocabulary, self.last
        lengths, borders, base = v.lengths, v.borders, max(0, start - v.longest + 1)
        for at, token in v.automaton.iter(self.data[base:end].decode("latin-1")):
            at += base
            if at < start or last[at] >= 0:
                continue
            before = at - lengths[token]
            if before < 0:
                if v.edges(token) is not None:
                    last[at] = token
                continue
            holds = borders.get(last[before] << SHIFT | token)
            if holds or (holds is None and v.follows(last[before], token)):
                last[at] = token

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Replace ``data[start:end]``; the number of entries computed anew."""
        old_tail = self.last[end:]
        self.data = self.data[:start] + new + self.data[end:]
        self.last = self.last[:start] + [-1] * (len(self.data) - start)
        window, done, fixed = self.vocabulary.longest, start, start + len(new)
        while done < len(self.data):
            step = min(len(self.data), max(done + window, fixed))
            self._fill(done, step)
            done = step
            # entries depend on the bytes and entries of one window only
            lo = max(fixed, done - window)
            if done - lo >= window and self.last[lo:done] == old_tail[lo - fixed : done - fixed]:
                self.last[done:] = old_tail[done - fixed :]
                break
        return done - start

    def ids(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.data)
        if whole is not None:
            return [whole]
        out, at, last, lengths = [], len(self.data) - 1, self.last, self.vocabulary.lengths
        while at >= 0:
            token = last[at]
            out.append(token)
            at -= lengths[token]
        out.reverse()
        return out


class Tokenizer:
    """Encodes whole texts; pieces seen before come from a bounded cache."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.pieces = regex.compile(pattern).findall
        self._packed: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _pack(self, piece: str) -> bytes:
        packed = self._older.get(piece)
        if packed is None:
            raw = piece.encode()
            ids = self.vocabulary.encode_piece(raw)
            packed = pack(f"<{len(ids)}I", *ids)
            if len(raw) > CACHE_BYTES:
                return packed
        if len(self._packed) >= CACHE_PIECES // 2:  # pieces in use come over again, the others go
            self._packed, self._older = {}, self._packed
        self._packed[piece] = packed
        return packed

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out, known, make = [], self._packed.get, self._pack
        for piece in self.pieces(text):
            packed = known(piece)
            if packed is None:
                packed = make(piece)
                known = self._packed.get  # the cache may be a new one
            out.append(packed)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode(self, ids) -> bytes:
        return self.vocabulary.decode(ids)


_TOKENIZERS: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(data: bytes, pattern: str) -> Tokenizer:
    """One tokenizer per process and vocabulary."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = Tokenizer(parse_ranks(data), pattern)
    return _TOKENIZERS[key]


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with an added column ``ids array<int>`` of whole texts.

    A null text counts as empty and gets an empty array.  The vocabulary file is
    read on the driver and sent to the workers; its size doesn't depend on the
    data.  Every row is encoded on its own: there is no shuffle.
    """
    data = docs.sparkSession.sparkContext.broadcast(open(vocabulary_path, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(data.value, pattern)
        for batch in batches:
            packed = [t.encode_packed(x or "") for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            offsets = np.zeros(len(packed) + 1, dtype=np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            flat = pa.array(np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[*batch.schema.names, ids])

    if ids in docs.columns:
        raise ValueError(f"the table already has a column {ids}")
    return small_batches(docs).mapInArrow(run, _schema(docs, f"{ids} array<int>"))


def decode(encoded: DataFrame, vocabulary_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with an added column ``decoded binary``; null ids give null."""
    data = encoded.sparkSession.sparkContext.broadcast(open(vocabulary_path, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(data.value, pattern)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = pa.array([None if r is None else t.decode(r) for r in rows], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, out])

    if out in encoded.columns:
        raise ValueError(f"the table already has a column {out}")
    return small_batches(encoded).mapInArrow(run, _schema(encoded, f"{out} binary"))


def round_trip(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """Encode and decode in one pass: counts and digests instead of the ids.

    Columns doc_id, n_tokens, ids_sha256, decoded_sha256, matches (the decoded
    bytes are the text's).  One row for each row of ``docs``; a null text counts
    as empty, repeated rows repeat, other columns are not read.
    """
    data = docs.sparkSession.sparkContext.broadcast(open(vocabulary_path, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(data.value, pattern)
        for batch in batches:
            counts, id_hashes, text_hashes, same = [], [], [], []
            for text in batch.column(1).to_pylist():
                packed = t.encode_packed(text or "")
                decoded = t.decode(np.frombuffer(packed, dtype="<u4").tolist())
                counts.append(len(packed) // 4)
                id_hashes.append(hashlib.sha256(packed).hexdigest())
                text_hashes.append(hashlib.sha256(decoded).hexdigest())
                same.append(decoded == (text or "").encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "matches"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, matches boolean")


def _schema(df: DataFrame, extra: str):
    return df.withColumn(extra.split()[0], F.lit(None).cast(extra.split(None, 1)[1])).schema
