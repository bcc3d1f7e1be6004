"""Edit-aware token counts.

A document's pre-tokens stand in the leaves of a segment tree, ``LEAF`` to a leaf,
with the sums of characters and tokens of every subtree above them. An edit
replaces the characters from start to end. The tree is descended to the pre-token
that the edit can affect first, the text is split again from there until a new
boundary falls on an old one behind the edit, and only those pre-tokens are
encoded; the sums above the touched leaves are mended and the rest stays.

Boundary context: a pre-token's end depends on at most ``LOOK_AHEAD`` characters
behind it, so splitting starts at the pre-token that holds the character that far
before the edit. To the right, the split from a boundary depends on what follows
only; once the boundaries meet, all later ones are the old ones.

Edits are applied in order, each to the text that the earlier ones left; places
outside the text are moved to its ends. A null text counts as empty, a null list
of edits as none, a null replacement as empty.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import map_batches, text_or_empty

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern of pre-tokens that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LOOK_AHEAD = 3
LEAF = 32
CACHED_WORDS, CACHED_LENGTH = 200_000, 64
EDITS = "array<struct<start:int,end:int,replacement:string>>"


class Counter:
    """Tokens of single pre-tokens, remembered per worker."""

    def __init__(self, ranks: bytes) -> None:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = len(self.encoding.encode_ordinary(word))
            if len(word) <= CACHED_LENGTH:
                if len(self.known) > CACHED_WORDS:
                    self.known.clear()
                self.known[word] = n
        return n

    def split(self, text: str) -> tuple[list[int], list[int]]:
        """(lengths, token counts) of the text's pre-tokens."""
        words = self.pattern.findall(text)
        known = self.known
        counts = [known.get(w) for w in words]
        if None in counts:
            counts = [self.count(w) if n is None else n for w, n in zip(words, counts, strict=True)]
        return list(map(len, words)), counts


class Tree:
    """Leaves of (lengths, counts) of pre-tokens, and per level the sums of characters and tokens."""

    def __init__(self, lengths: list[int], counts: list[int]) -> None:
        self.encoded = 0  # pre-tokens that edits have encoded
        self._build(lengths, counts)

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        cuts = range(0, max(1, len(lengths)), LEAF)
        self.leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in cuts]
        level = np.array([(sum(a), sum(b)) for a, b in self.leaves], np.int64).reshape(-1, 2)
        self.levels = [level]
        while len(level) > 1:
            if len(level) % 2:
                level = np.concatenate([level, np.zeros((1, 2), np.int64)])
                self.levels[-1] = level
            level = level[0::2] + level[1::2]
            self.levels.append(level)

    @property
    def n_chars(self) -> int:
        return int(self.levels[-1][0, 0])

    @property
    def n_tokens(self) -> int:
        return int(self.levels[-1][0, 1])

    def pieces(self) -> tuple[list[int], list[int]]:
        return [x for a, _ in self.leaves for x in a], [x for _, b in self.leaves for x in b]

    def find(self, char: int) -> tuple[int, int, int]:
        """(leaf, place in it, first character) of the pre-token that holds a character."""
        node = start = 0
        for level in reversed(self.levels[:-1]):
            node *= 2
            if char >= start + level[node, 0]:
                start += int(level[node, 0])
                node += 1
        for place, length in enumerate(self.leaves[node][0]):
            if char < start + length:
                return node, place, start
            start += length
        raise IndexError(char)

    def _mend(self, first: int, last: int) -> None:
        for leaf in range(first, last + 1):
            self.levels[0][leaf] = sum(self.leaves[leaf][0]), sum(self.leaves[leaf][1])
        for below, level in zip(self.levels, self.levels[1:], strict=False):
            first, last = first // 2, last // 2
            level[first : last + 1] = below[2 * first : 2 * last + 2 : 2] + below[2 * first + 1 : 2 * last + 2 : 2]

    def edit(self, text: str, start: int, end: int, replacement: str, counter: Counter) -> str:
        """Applies one edit to the tree of ``text`` and returns the new text."""
        start = min(max(start, 0), len(text))
        end = min(max(end, start), len(text))
        out = text[:start] + replacement + text[end:]
        if not text:
            lengths, counts = counter.split(out)
            self.encoded += len(lengths)
            self._build(lengths, counts)
            return out
        moved = len(out) - len(text)
        leaf, place, old = self.find(min(max(0, start - LOOK_AHEAD), len(text) - 1))
        first, head, at = leaf, place, old
        lengths: list[int] = []
        counts: list[int] = []
        met = at + moved == old and not replacement and start == end
        for match in () if met else counter.pattern.finditer(out, at):
            lengths.append(match.end() - match.start())
            counts.append(counter.count(match.group()))
            at = match.end()
            if at < start + len(replacement):
                continue
            while old < at - moved:
                while place >= len(self.leaves[leaf][0]):
                    leaf, place = leaf + 1, 0
                old += self.leaves[leaf][0][place]
                place += 1
            if old == at - moved and old >= end:
                break
        else:
            if not met:  # the new text ends before any boundary is met
                leaf, place = len(self.leaves) - 1, len(self.leaves[-1][0])
        self.encoded += len(lengths)
        kept = self.leaves[first], self.leaves[leaf]
        for empty in range(first + 1, leaf + 1):
            self.leaves[empty] = ([], [])
        self.leaves[first] = tuple(kept[0][i][:head] + new + kept[1][i][place:] for i, new in enumerate((lengths, counts)))
        if len(self.leaves[first][0]) > 4 * LEAF:
            self._build(*self.pieces())
        else:
            self._mend(first, leaf)
        return out


def packed(tree: Tree) -> bytes:
    """Lengths, then counts, of the pre-tokens; sums are rebuilt from them."""
    return np.array(tree.pieces(), np.uint32).tobytes()


def unpacked(data: bytes) -> Tree:
    lengths, counts = np.frombuffer(data, np.uint32).reshape(2, -1).tolist()
    return Tree(lengths, counts)


# --- tables ---------------------------------------------------------------------

_COUNTERS: dict[int, Counter] = {}


def counter(ranks: bytes) -> Counter:
    key = hash(ranks)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(ranks)
    return _COUNTERS[key]


def read_ranks(path: str = RANKS) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def counted(docs: DataFrame, keys: dict[str, Column], ranks: bytes, edits: Column | None = None, full: bool = False) -> DataFrame:
    """Counts before and after the edits of a row (``edits``: an array of start, end, replacement).

    The key columns, n_pretokens, n_tokens, edited_tokens, edited_chars and
    encoded_pretokens (those that the edits had encoded). With ``full`` also
    edited_text and tree, the state from which :func:`recounted` goes on.
    """
    none = F.array().cast(EDITS)
    rows = docs.select(
        *[c.alias(n) for n, c in keys.items()],
        text_or_empty().alias("_text"),
        F.lit(None).cast("binary").alias("_tree"),
        (none if edits is None else F.coalesce(edits.cast(EDITS), none)).alias("_edits"),
    )
    return _folded(rows, list(keys), ranks, full)


def recounted(trees: DataFrame, keys: dict[str, Column], ranks: bytes, edits: Column) -> DataFrame:
    """Further edits of rows that have ``edited_text`` and ``tree``; nothing but the edited regions is encoded."""
    rows = trees.select(
        *[c.alias(n) for n, c in keys.items()],
        F.col("edited_text").alias("_text"),
        F.col("tree").alias("_tree"),
        F.coalesce(edits.cast(EDITS), F.array().cast(EDITS)).alias("_edits"),
    )
    return _folded(rows, list(keys), ranks, True)


def _folded(rows: DataFrame, names: list[str], ranks: bytes, full: bool) -> DataFrame:
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(names)])
    numbers = ("n_pretokens", "n_tokens", "edited_tokens", "edited_chars", "encoded_pretokens")
    schema = kept + ", ".join(f"{n} long" for n in numbers) + (", edited_text string, tree binary" if full else "")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(ranks)
        for batch in batches:
            made: list[tuple] = []
            for text, tree, edits in zip(*(batch[c] for c in ("_text", "_tree", "_edits")), strict=True):
                text = text.as_py()
                held = unpacked(tree.as_py()) if tree.is_valid else Tree(*tool.split(text))
                row = [sum(len(a) for a, _ in held.leaves), held.n_tokens]
                for e in edits.as_py():
                    text = held.edit(text, e["start"] or 0, e["end"] or 0, e["replacement"] or "", tool)
                row += [held.n_tokens, held.n_chars, held.encoded]
                made.append((*row, text, packed(held)) if full else tuple(row))
            columns = [pa.array(c, pa.int64()) for c in zip(*[m[:5] for m in made], strict=True)] or [pa.array([], pa.int64())] * 5
            if full:
                columns += [pa.array([m[5] for m in made], pa.string()), pa.array([m[6] for m in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*[batch[n] for n in names], *columns], [*names, *numbers, *(("edited_text", "tree") if full else ())]
            )

    return map_batches(rows, fold, schema)


def attach(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """``trees`` with an ``edits`` column from a table of edits (doc_id, seq, start, end, replacement).

    The edits of one document depend on each other and are one row; give them in
    batches. Documents without edits have none; edits of unknown documents go.
    """
    lists = edits.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_of")).agg(
        F.sort_array(F.collect_list(F.struct("seq", "start", "end", "replacement"))).alias("_all")
    )
    picked = F.transform("_all", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["replacement"].alias("replacement")))
    return trees.join(lists, F.col("doc_id") == F.col("_of"), "left").select(*[F.col(c) for c in trees.columns], picked.alias("edits"))


def sample_edits(text: Column) -> Column:
    """Three edits of a text, from its own words: a cut, a change inside a word and an addition."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")

    def one(start: Column, end: Column, replacement: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), replacement.alias("replacement"))

    return F.array(
        one(third, third + 25, F.lit("")),
        one(F.floor(n / 2), F.floor(n / 2) + 3, F.concat(F.substring(text, 1, 12), F.lit("'ll"))),
        one(n + 40, n + 40, F.concat(F.lit("  "), F.substring(text, -30, 30))),
    )
