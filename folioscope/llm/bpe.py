"""Byte-level BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a piece there is exactly one token that ends the piece's BPE encoding. An automaton over the
vocabulary with suffix links lists, at every position, all tokens that are suffixes of the prefix read so far; a token
is the stored last token if it is compatible with the last token of the prefix before it, that is, if BPE would leave
the two side by side. Back-pointers then give the exact ids in time linear in the piece, long runs included.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm import kernels as K
from folioscope.operators.ship import ship

NEVER = 1 << 60
#: Pieces kept per worker; the table is emptied when it is full, so it is a bound on memory, not on input.
CACHE = 250_000
#: How byte-level vocabularies split a text before merging (a fixed public pattern).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, the other bytes for letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixEncoder:
    """Ids of a text as the vocabulary file defines them; ``cache`` maps pieces to their ids as little-endian bytes."""

    def __init__(self, spec: str):
        import ahocorasick
        import regex

        spec = json.loads(spec)
        model, letters = spec["model"], byte_letters()
        plain = lambda s: "".join(chr(letters[c]) for c in s)  # noqa: E731  one Latin-1 letter a byte
        self.bytes = [b""] * (1 + max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]))
        self.auto = ahocorasick.Automaton()
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in model["vocab"].items():
            if token in specials:
                continue
            text = plain(token)
            self.bytes[i] = text.encode("latin-1")
            self.auto.add_word(text, (len(text), i))
        for content, i in specials.items():
            self.bytes[i] = content.encode()
        self.auto.make_automaton()
        self.word = [i.to_bytes(4, "little") for i in range(len(self.bytes))]
        self.ranks: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.ranks[x << 32 | y] = rank
            self.parts.setdefault(z, (x, y, rank))
        self.split = regex.compile(PIECES).findall
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")") if specials else None
        self.special_ids = {s: np.uint32(i).astype("<u4").tobytes() for s, i in specials.items()}
        self.ok: dict[int, bool] = {}
        self.spine = functools.lru_cache(None)(self._spine)
        encoder = self

        class Cache(dict):
            def __missing__(self, piece: str) -> bytes:
                out = encoder.piece(piece)
                if len(piece) <= 48:
                    if len(self) >= CACHE:
                        self.clear()
                    self[piece] = out
                return out

        self.cache = Cache()

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens along the right (1) or left (0) edge while ``token`` is built, from its byte up, each with the rank of the merge that consumes it."""
        out, until = [(token, NEVER)], NEVER
        while token in self.parts:
            x, y, until = self.parts[token]
            token = y if side else x
            out.append((token, until))
        return out[::-1]

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b side by side: no merge over their border comes before the merges on both of its sides."""
        left, right, i, j = self.spine(a, 1), self.spine(b, 0), 0, 0
        while True:
            (x, px), (y, py) = left[i], right[j]
            m = self.ranks.get(x << 32 | y)
            if m is not None and m < px and m <= py:
                return False
            if px == py == NEVER:
                return True
            if px <= py:
                i += 1
            else:
                j += 1

    def piece(self, piece: str) -> bytes:
        s = piece if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("latin-1")
        last = [-1] * (len(s) + 1)  # the last token of each prefix, by its length
        last[0] = 0
        back = last.copy()
        ok, done = self.ok, -1
        for end, (n, token) in self.auto.iter(s):
            if end == done:
                continue
            start = end + 1 - n
            if start:
                key = last[start] << 32 | token
                fits = ok.get(key)
                if fits is None:
                    if len(ok) >= 2 * CACHE:
                        ok.clear()
                    fits = ok[key] = self.compatible(last[start], token)
                if not fits:
                    continue
            last[end + 1], back[end + 1], done = token, start, end
        out, end, word = [], len(s), self.word
        while end:
            out.append(word[last[end]])
            end = back[end]
        out.reverse()
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get = self.cache.__getitem__
        if self.special is None or not self.special.search(text):
            return b"".join(map(get, self.split(text)))
        return b"".join(self.special_ids[s] if s in self.special_ids else b"".join(map(get, self.split(s))) for s in self.special.split(text) if s)

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def encoder(spec: str) -> PrefixEncoder:
    return K.kept("bpe", spec, lambda: PrefixEncoder(spec))


def _renamed(schema: T.StructType, *new: tuple[str, T.DataType]) -> T.StructType:
    fresh = {n for n, _ in new}
    return T.StructType([f for f in schema.fields if f.name not in fresh] + [T.StructField(n, t) for n, t in new])


def bpe_encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "token_ids", round_trip: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` array<int>, the exact BPE ids of the whole text under the vocabulary file at ``vocabulary``.

    With ``round_trip``, a boolean column of that name tells whether the ids decode to the text again, in the same pass.

    A null or empty text has no ids. Rows are independent, so repeated rows get equal ids; a column already called
    ``ids`` is replaced, every other column is kept. No shuffle: one pass in Arrow batches. The vocabulary (under 2 MB)
    is sent with the plan, so executors need no file.
    """
    ship(docs.sparkSession)
    spec = Path(vocabulary).read_text()
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    new = [(ids, T.ArrayType(T.IntegerType())), *([(round_trip, T.BooleanType())] if round_trip else [])]
    schema = _renamed(docs.schema, *new)
    keep = [f.name for f in schema.fields if f.name not in (ids, round_trip)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for big in batches:
            for i in range(0, big.num_rows, 500):
                batch = big.slice(i, 500)
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                found = [enc.encode(t or "") for t in texts]
                flat = np.frombuffer(b"".join(found), "<u4").astype(np.int32)
                at = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]
                if round_trip:
                    columns.append(pa.array([enc.decode(np.frombuffer(x, "<u4").tolist()) == (t or "") for x, t in zip(found, texts, strict=True)]))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + columns, names=[*keep, *(n for n, _ in new)])
        K.release()

    return docs.mapInArrow(run, schema)


def bpe_decode(docs: DataFrame, vocabulary: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``docs`` with ``text``, the decoded ids (special tokens kept; null ids give null)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())
    schema = _renamed(docs.schema, (text, T.StringType()))
    keep = [f.name for f in schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for big in batches:
            for i in range(0, big.num_rows, 500):
                batch = big.slice(i, 500)
                out = [None if x is None else enc.decode(x) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(out, pa.string())], names=[*keep, text])

    return docs.mapInArrow(run, schema)


def bpe_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: the whole text encoded, its ids decoded again, both digested in one pass.

    A null text is an empty one, with 0 tokens and the digests of nothing. Each row is encoded on its own, repeated rows and rows
    of one doc_id alike; a null doc_id stays null. Very long texts are encoded whole, in memory linear in one text. Other
    columns are not read; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for big in batches:
            for i in range(0, big.num_rows, 500):
                batch = big.slice(i, 500)
                found = [enc.encode(t or "") for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(x) // 4 for x in found], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()),
                        pa.array([hashlib.sha256(enc.decode(np.frombuffer(x, "<u4").tolist()).encode()).hexdigest() for x in found], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        K.release()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
