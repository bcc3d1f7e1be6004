"""Byte-level BPE encoding and decoding on the tokenizers library.

The rank file gives the tokens as bytes. The library works on characters, so each
byte stands for one printable character; the table of them is its own rule. Merges
are rebuilt from the ranks: a token can be put together from every two tokens that
make it up, at the token's own rank, as ranks alone decide what is joined next.

Each match of the pattern is encoded by itself. A match that is met again is taken
from a cache per worker; the new ones of a slice of documents go to the library
as one batch.

Decoding takes each id's bytes and puts them one after the other, so a character
that several tokens share is whole again. The bytes are the result; as a string,
those that are no UTF-8 become U+FFFD.

A null text counts as empty and has no tokens; null ids count as none, ids that
are null or outside the vocabulary stand for no bytes. Texts are processed whole.
Only the columns asked for are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import map_batches, text_or_empty

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern of the texts' parts that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED_BYTES, PART_COST = 48_000_000, 160  # of the parts remembered, and what each takes besides its own bytes
CACHED_LENGTH = 256  # longer parts are encoded each time
DOCS_AT_ONCE = 128


def byte_characters() -> list[str]:
    """The character of each byte: itself where it is printable and no blank, else the next from U+0100 on."""
    shown = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b for b in range(256)]
    hidden = iter(range(256, 512))
    return [chr(b if shown[b] else next(hidden)) for b in range(256)]


def ways(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Where a token can be cut into two others.

    Of overlapping pairs with the same result the left one is joined. The library
    takes the cut that is listed first, so cuts that repeat the token's beginning
    (where two such pairs can overlap) come first, shorter ones before longer.
    """
    n = len(token)
    cuts = [p for p in range(1, n) if token[:p] in ranks and token[p:] in ranks]
    return sorted(cuts, key=lambda p: (token[p:] != token[: n - p], p))


class ByteCodec:
    def __init__(self, ranks: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer, models, pre_tokenizers

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        chars = byte_characters()
        shown = {token: "".join([chars[b] for b in token]) for token in table}
        merges = [
            (shown[token[:p]], shown[token[p:]])
            for token in sorted((t for t in table if len(t) > 1), key=table.__getitem__)
            for p in ways(token, table)
        ]
        core = models.BPE({shown[t]: i for t, i in table.items()}, merges, ignore_merges=True)
        self.tool = Tokenizer(core)
        self.tool.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern = regex.compile(PATTERN)
        back = {c: b for b, c in enumerate(chars)}
        words = [b""] * (max(table.values(), default=-1) + 1)
        for i in range(len(words)):
            words[i] = bytes([back[c] for c in self.tool.id_to_token(i) or ""])
        #: The bytes of each id, and of nothing as the last.
        self.bytes = pa.array([*words, b""], pa.binary())
        self.lengths = np.array([len(w) for w in words] + [0], np.int64)
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, parts: list[list[str]]) -> dict[str, bytes]:
        """The ids of all the parts that the cache does not keep; the others are put into it."""
        if self.held > CACHED_BYTES:
            self.cache.clear()
            self.held = 0
        cache = self.cache
        new = list({p for text in parts for p in text if p not in cache})
        once = {}
        for part, made in zip(new, self.tool.encode_batch_fast(new, add_special_tokens=False), strict=True):
            ids = array("i", made.ids).tobytes()
            if len(part) > CACHED_LENGTH:
                once[part] = ids
            else:
                self.cache[part] = ids
                self.held += len(part) + len(ids) + PART_COST
        return once

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [self.pattern.findall(t) for t in texts]
        once = self._learn(parts)
        cache = self.cache
        if once:
            return [np.frombuffer(b"".join([once[p] if p in once else cache[p] for p in text]), np.int32) for text in parts]
        return [np.frombuffer(b"".join([cache[p] for p in text]), np.int32) for text in parts]

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes of a list column of ids."""
        flat = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        last = len(self.bytes) - 1
        flat = np.where((flat < 0) | (flat > last), last, flat)
        ends = np.r_[0, np.cumsum(self.lengths[flat])]
        counts = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        bounds = ends[np.r_[0, np.cumsum(counts)]]
        # A binary column's values lie one after the other, which is the decoded text already.
        _, _, values = self.bytes.take(pa.array(flat)).buffers()
        offsets = pa.py_buffer(bounds.astype(np.int64).tobytes())
        return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, offsets, values or pa.py_buffer(b"")])

    def places(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last character of each token, counting every character it has a byte of."""
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        heads = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        character = np.cumsum(heads) - 1  # of each byte
        return character[starts], character[ends - 1] + 1


_CODECS: dict[int, ByteCodec] = {}


def codec(ranks: bytes) -> ByteCodec:
    """One codec per worker and rank file."""
    key = hash(ranks)
    if key not in _CODECS:
        _CODECS[key] = ByteCodec(ranks)
    return _CODECS[key]


def read_ranks(path: str = RANKS) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _listed(arrays: list[np.ndarray]) -> pa.ListArray:
    lengths = [len(x) for x in arrays]
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(flat))


def _kept(rows: DataFrame, n: int) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])


def encoded(docs: DataFrame, keys: dict[str, Column], ranks: bytes, offsets: bool = False, decode: bool = False) -> DataFrame:
    """The key columns, ``ids`` and ``n_tokens`` per row.

    ``offsets`` adds the characters of each token (``starts``, ``ends``); tokens
    that share a character name it both. ``decode`` adds ``decoded``, the bytes
    that the ids stand for.
    """
    names = list(keys)
    rows = docs.select(*[c.alias(n) for n, c in keys.items()], text_or_empty().alias("_text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(ranks)
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(start, DOCS_AT_ONCE)
                texts = part.column(len(names)).to_pylist()
                ids = tool.encode(texts)
                lists = _listed(ids)
                columns = {"ids": lists, "n_tokens": pa.array([len(x) for x in ids], pa.int64())}
                if offsets:
                    spans = [tool.places(t.encode(), x) for t, x in zip(texts, ids, strict=True)]
                    columns |= {"starts": _listed([a for a, _ in spans]), "ends": _listed([b for _, b in spans])}
                if decode:
                    columns["decoded"] = tool.decode(lists).cast(pa.binary())
                arrays = [*[part.column(i) for i in range(len(names))], *columns.values()]
                yield pa.RecordBatch.from_arrays(arrays, [*names, *columns])

    more = ", starts array<int>, ends array<int>" * offsets + ", decoded binary" * decode
    return map_batches(rows, encode, f"{_kept(rows, len(names))}, ids array<int>, n_tokens long{more}")


def decoded(rows: DataFrame, keys: dict[str, Column], ranks: bytes, ids: str = "ids") -> DataFrame:
    """The key columns, the ``bytes`` of the ids, and these as ``text``."""
    names = list(keys)
    rows = rows.select(*[c.alias(n) for n, c in keys.items()], F.coalesce(ids, F.array().cast("array<int>")).alias("_ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(ranks)
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(start, DOCS_AT_ONCE)
                made = tool.decode(part.column(len(names))).cast(pa.binary())
                texts = pa.array([x.decode("utf-8", "replace") for x in made.to_pylist()], pa.string())
                arrays = [*[part.column(i) for i in range(len(names))], made, texts]
                yield pa.RecordBatch.from_arrays(arrays, [*names, "bytes", "text"])

    return map_batches(rows, decode, f"{_kept(rows, len(names))}, bytes binary, text string")
