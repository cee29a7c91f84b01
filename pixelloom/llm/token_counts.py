"""Token counts that follow edits: a segment tree over each document's stretches of text; an edit re-encodes only what it touches.

A tree is kept beside its text as two arrays, the characters and the tokens of each leaf: plant() makes them, edit() and count() go on from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pixelloom.llm.bpe import OUT_BYTES, Bpe, model
from pixelloom.llm.common import free_name, others, slices

#: Characters of a leaf before it ends at the next white space. No token reaches over white space, so leaves are counted one by one.
LEAF_CHARS = 256
LEAF = regex.compile(r"(?s).{%d}\P{White_Space}*\p{White_Space}*|.+" % LEAF_CHARS)
SPACE = regex.compile(r"\p{White_Space}")

EDITS = "array<struct<at:int,remove:int,insert:string>>"
TREE = "struct<chars:array<int>,tokens:array<int>>"


class TokenTree:
    """Sums of characters and tokens over the leaves of one text. Every leaf but the last with text ends in white space."""

    def __init__(self, text: str, bpe: Bpe, kept: dict | None = None):
        """kept: chars and tokens of the leaves, from a tree of this text; one that isn't of a text of this length is planted anew."""
        self.bpe, self.encoded_chars = bpe, 0
        if kept is not None and kept["chars"] and sum(kept["chars"]) == len(text) and len(kept["chars"]) == len(kept["tokens"]):
            ends = list(accumulate(kept["chars"]))
            self._plant([text[a:b] for a, b in zip([0, *ends], ends)], kept["tokens"])
        else:
            self._plant(LEAF.findall(text), None)

    def kept(self) -> dict:
        """What the tree can be made from again, beside its text. Leaves without text are left out."""
        n = [(len(s), self.tokens[self.size + i]) for i, s in enumerate(self.leaves) if s]
        return {"chars": [c for c, _ in n], "tokens": [t for _, t in n]}

    def _count(self, s: str) -> int:
        self.encoded_chars += len(s)
        return sum(map(len, self.bpe.pieces(s))) // 4 if s else 0

    def _plant(self, leaves: list[str], counts: list[int] | None) -> None:
        self.leaves = leaves or [""]
        size = 1
        while size < len(self.leaves):
            size *= 2
        self.size, self.chars, self.tokens = size, [0] * (2 * size), [0] * (2 * size)
        for i, s in enumerate(self.leaves):
            self.chars[size + i], self.tokens[size + i] = len(s), self._count(s) if counts is None else counts[i] if s else 0
        for i in range(size - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _set(self, i: int, s: str) -> None:
        self.leaves[i], at = s, self.size + i
        self.chars[at], self.tokens[at] = len(s), self._count(s)
        while at := at // 2:
            self.chars[at], self.tokens[at] = self.chars[2 * at] + self.chars[2 * at + 1], self.tokens[2 * at] + self.tokens[2 * at + 1]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf with character at, and where it begins; the last leaf with text for the text's end."""
        node, left = 1, 0
        while node < self.size:
            node *= 2
            if at - left >= self.chars[node] and self.chars[node + 1]:
                left += self.chars[node]
                node += 1
        return node - self.size, left

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def edit(self, at: int, remove: int, insert: str | None) -> None:
        """Replace remove characters from at on by insert; what lies outside of the text is cut off."""
        n = self.chars[1]
        at = min(max(at or 0, 0), n)
        end = min(at + max(remove or 0, 0), n)
        first, begin = self._find(at)
        last, last_begin = self._find(end) if end > at else (first, begin)
        region = self.leaves[first][: at - begin] + (insert or "") + self.leaves[last][end - last_begin :]
        while not (region and SPACE.match(region[-1])) and last + 1 < len(self.leaves):  # the context up to white space
            last += 1
            region += self.leaves[last]
        for i in range(first + 1, last + 1):
            self._set(i, "")
        if len(region) <= 8 * LEAF_CHARS:
            self._set(first, region)
        else:  # a long insert: new leaves for it, the others keep their counts
            parts = LEAF.findall(region)
            counts = [self.tokens[self.size + i] for i in range(len(self.leaves))]
            self._plant(self.leaves[:first] + parts + self.leaves[last + 1 :], counts[:first] + [self._count(s) for s in parts] + counts[last + 1 :])


def _mapped(df: DataFrame, path: str, text: str, edits: str | None, tree: str | None, added: dict[str, str], of) -> DataFrame:
    """df without text, edits, tree and columns named as the added ones, plus these: of(text, edits, tree kept before, encoder)."""
    keep = others(df, [text, edits, tree, *added])
    schema = df.select(*keep, *[F.lit(None).cast(kind).alias(name) for name, kind in added.items()]).schema
    types = to_arrow_schema(schema).types[len(keep) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, n = model(path), len(keep)
        for batch in batches:
            for a, b in slices(batch.column(n), OUT_BYTES):
                part = batch.slice(a, b - a)
                columns = zip(*(part.column(n + k).to_pylist() for k in range(3)))
                rows = [of(t or "", [e for e in changes or [] if e is not None], before, bpe) for t, changes, before in columns]
                made = [pa.array(c, kind) for c, kind in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(n)] + made, names=[*keep, *added])

    given = [F.col(c) if c else F.lit(None).cast(kind) for c, kind in ((text, "string"), (edits, EDITS), (tree, TREE))]
    names = free_names(keep, 3)
    return df.select(*keep, *[c.alias(n) for c, n in zip(given, names)]).mapInArrow(run, schema)


def free_names(names: list[str], n: int) -> list[str]:
    out: list[str] = []
    for k in range(n):
        out.append(free_name([*names, *out], f"given{k}"))
    return out


def _edited(text: str, edits: list[dict], kept: dict | None, bpe: Bpe) -> tuple[TokenTree, int, int]:
    tree = TokenTree(text, bpe, kept)
    before, first = tree.n_tokens, tree.encoded_chars
    for e in edits:
        tree.edit(e["at"], e["remove"], e["insert"])
    return tree, before, first


def plant(df: DataFrame, path: str, text: str = "text", tree: str = "tree") -> DataFrame:
    """df with text (null: empty) and its tree (TREE) beside it. A column named as the tree, in any case, is replaced; otherwise as count()."""

    def of(t: str, edits: list, before: dict | None, bpe: Bpe) -> tuple:
        return t, TokenTree(t, bpe).kept()

    return _mapped(df, path, text, None, None, {text: "string", tree: TREE}, of)


def edit(df: DataFrame, path: str, edits: str, text: str = "text", tree: str = "tree") -> DataFrame:
    """df without edits, with text and tree as the edits leave them, plus n_tokens and encoded_chars (long). Only what the edits touch, with the
    context up to white space, is encoded. Otherwise as count()."""

    def of(t: str, changes: list, before: dict | None, bpe: Bpe) -> tuple:
        made, _, first = _edited(t, changes, before, bpe)
        return made.text(), made.kept(), made.n_tokens, made.encoded_chars

    return _mapped(df, path, text, edits, tree, {text: "string", tree: TREE, "n_tokens": "long", "encoded_chars": "long"}, of)


def count(df: DataFrame, path: str, text: str = "text", edits: str | None = None, tree: str | None = None) -> DataFrame:
    """df without its columns text, edits and tree, plus n_tokens, n_tokens_after, n_leaves, first_chars, edit_chars (long).

    n_tokens counts the tokens of the whole text as bpe.encode() makes them; n_tokens_after counts those after the edits of the column edits
    (array of {at, remove, insert}, in order, each on the text that the one before left). first_chars and edit_chars are the characters
    encoded for the first count and for all edits; with a tree of the text the first count encodes nothing. A null text is empty, null edits are
    none, null fields of an edit are 0 or empty, a null tree is planted. Columns named like the result's, in any case, are replaced; repeated rows
    and empty tables need no care; a text of any length is read whole. Nothing is shuffled.
    """

    def of(t: str, changes: list, before: dict | None, bpe: Bpe) -> tuple:
        made, n, first = _edited(t, changes, before, bpe)
        return n, made.n_tokens, len(made.leaves), first, made.encoded_chars - first

    return _mapped(df, path, text, edits, tree, dict.fromkeys(["n_tokens", "n_tokens_after", "n_leaves", "first_chars", "edit_chars"], "long"), of)
