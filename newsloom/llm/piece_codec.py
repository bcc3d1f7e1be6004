"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed as protobuf; its normaliser, blank marker, scores or
merges and byte fallback are rebuilt as a tokenizers pipeline. Texts are cut
where a blank marker begins a word, which changes nothing as long as no piece has
a marker inside (checked at loading; otherwise texts stay whole). So each distinct
word is encoded and decoded once per worker, in batches on the library's threads,
and each is compared with what the SentencePiece library gives: that is the parity
check. The ids are the tokenizers library's; ``parity`` is false where a word's
differ from SentencePiece's. A text decodes to its words' texts one after the
other, as no byte sequence goes on behind a marker.

A null text counts as empty and has no ids. Texts are processed whole. The
vocabulary file is a parameter; its bytes travel to the tasks with the function.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import map_batches, text_or_empty
from newsloom.session import bound_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CACHED_CHARS, WORD_COST = 16_000_000, 64  # of the words remembered, and what each adds to its characters
DOCS_AT_ONCE = 128

# Piece and model kinds of the format.
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2


# --- the model file -------------------------------------------------------------


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class Model:
    """pieces [(text, score, kind)], kind, charsmap and the flags of the normaliser."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normalizer: dict = {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
                self.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = normalizer.get(2, b"")
        self.prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), None)

    def merges(self) -> list[tuple[str, str]]:
        """All ways to put a piece together from two others, best score first."""
        ids = {text: i for i, (text, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        out = []
        for i, (text, score, kind) in enumerate(self.pieces):
            for cut in range(1, len(text)) if kind == NORMAL else ():
                left, right = text[:cut], text[cut:]
                if left in ids and right in ids:
                    out.append((-score, i, ids[left], ids[right], left, right))
        return [(left, right) for *_, left, right in sorted(out)]


# --- the codec ------------------------------------------------------------------


class Codec:
    def __init__(self, data: bytes, threads: int = 2) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        import sentencepiece
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

        self.model = model = Model(data)
        self.judge = sentencepiece.SentencePieceProcessor(model_proto=data)
        unknown = model.pieces[model.unknown][0] if model.unknown is not None else None
        if model.kind == BPE:
            vocabulary = {text: i for i, (text, _, _) in enumerate(model.pieces)}
            core = models.BPE(
                vocabulary, model.merges(), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback
            )
        elif model.kind == UNIGRAM:
            core = models.Unigram(
                [(text, score) for text, score, _ in model.pieces], model.unknown, byte_fallback=model.byte_fallback
            )
        else:
            raise ValueError(f"model kind {model.kind} is neither unigram nor BPE")
        self.words = Tokenizer(core)  # takes normalised words
        self.words.add_tokens([AddedToken(t, normalized=False) for t, _, kind in model.pieces if kind == USER])
        steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
        if model.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if model.prefix:
            steps.append(normalizers.Prepend(MARK))
        self.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        self.plain = model.prefix and not model.charsmap and not model.squeeze
        self.words.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.cut = not any(MARK in text.lstrip(MARK) for text, _, _ in model.pieces)
        self.texts = ["" if kind == BYTE else text for text, _, kind in model.pieces]
        self.cache: dict[str, bytes] = {}
        self.differ: set[str] = set()
        self.altered: dict[str, str] = {}  # words that do not decode to themselves, and what they decode to
        self.held = 0

    def normalized(self, text: str) -> str:
        if self.plain:
            return MARK + text.replace(" ", MARK) if text else ""
        return self.normalizer.normalize_str(text)

    def split(self, text: str) -> list[str]:
        text = self.normalized(text)
        return WORD.findall(text) if self.cut else [text] if text else []

    def _learn(self, words: list[list[str]]) -> None:
        """Puts the ids of all new words into the cache, and those that the libraries encode differently into ``differ``."""
        if self.held > CACHED_CHARS:
            self.cache.clear()
            self.held = 0
        cache = self.cache
        new = sorted({w for text in words for w in text if w not in cache})
        ours = [x.ids for x in self.words.encode_batch_fast(new, add_special_tokens=False)]
        bare = [(w[1:] if self.model.prefix and w[:1] == MARK else w).replace(MARK, " ") for w in new]
        theirs = self.judge.encode(bare)
        texts = self.texts
        other = []  # words that are not just their pieces' texts, as where bytes stand in for a character
        for word, a, b, asked in zip(new, ours, theirs, bare, strict=True):
            if a != b and asked:  # a lone marker is no text by itself, so there is nothing to compare
                self.differ.add(word)
            if "".join([texts[i] for i in a]) != word:
                other.append((word, a))
            cache[word] = array("i", a).tobytes()
        self.held += sum(map(len, new)) + WORD_COST * len(new)
        back = self.words.decode_batch([a for _, a in other], skip_special_tokens=False) if other else []
        self.altered |= {w: made for (w, _), made in zip(other, back, strict=True) if made != w.replace(MARK, " ")}

    def _without_prefix(self, text: str) -> str:
        return text[1:] if self.model.prefix and text[:1] == " " else text

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool, bool]]:
        """Per text its ids, whether both libraries agree on all its words, and whether the ids decode to the text."""
        words = [self.split(t) for t in texts]
        self._learn(words)
        cache = self.cache
        out = []
        for given, text in zip(texts, words, strict=True):
            ids = np.frombuffer(b"".join([cache[w] for w in text]), np.int32)
            if self.altered and not self.altered.keys().isdisjoint(text):
                back = "".join([self.altered[w] if w in self.altered else w.replace(MARK, " ") for w in text])
            else:
                back = "".join(text).replace(MARK, " ")
            out.append((ids, not self.differ or self.differ.isdisjoint(text), self._without_prefix(back) == given))
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The texts of whole lists of ids."""
        made = self.words.decode_batch([list(map(int, x)) for x in ids], skip_special_tokens=False)
        return [self._without_prefix(t) for t in made]


# --- tables ---------------------------------------------------------------------

_CODECS: dict[tuple[int, int], Codec] = {}


def codec(data: bytes, threads: int = 2) -> Codec:
    """One codec per worker and model."""
    key = (hash(data), threads)
    if key not in _CODECS:
        _CODECS[key] = Codec(data, threads)
    return _CODECS[key]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encoded(docs: DataFrame, keys: dict[str, Column], model: bytes, threads: int = 2) -> DataFrame:
    """The key columns, ids, n_tokens, round_trip (decoding gives the text back) and parity per row."""
    names = list(keys)
    rows = docs.select(*[c.alias(n) for n, c in keys.items()], text_or_empty().alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    bound_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model, threads)
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(start, DOCS_AT_ONCE)
                texts = part["_text"].to_pylist()
                done = tool.encode(texts)
                ids = [x for x, _, _ in done]
                lengths = np.array([len(x) for x in ids], np.int64)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [*[part[n] for n in names], lists, pa.array(lengths), pa.array([b for _, _, b in done]), pa.array([p for _, p, _ in done])],
                    [*names, "ids", "n_tokens", "round_trip", "parity"],
                )

    return map_batches(rows, encode, f"{kept}, ids array<int>, n_tokens long, round_trip boolean, parity boolean")


def decoded(rows: DataFrame, keys: dict[str, Column], model: bytes, threads: int = 2) -> DataFrame:
    """The key columns and the text of ``ids``; null ids count as none."""
    names = list(keys)
    rows = rows.select(*[c.alias(n) for n, c in keys.items()], F.coalesce("ids", F.array().cast("array<int>")).alias("_ids"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    bound_batches(rows.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model, threads)
        for batch in batches:
            for start in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(start, DOCS_AT_ONCE)
                texts = tool.decode(part["_ids"].to_pylist())
                yield pa.RecordBatch.from_arrays([*[part[n] for n in names], pa.array(texts, pa.string())], [*names, "text"])

    return map_batches(rows, decode, f"{kept}, text string")
