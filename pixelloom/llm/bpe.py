"""BPE encoding and decoding by dynamic programming over prefixes.

For each prefix of a word there is one token that ends its encoding. An automaton reports the vocabulary's tokens that are a prefix's suffixes; the
one that may stand after the last token of the prefix before it is stored; following these back from the end gives the ids. Whether two
tokens may stand side by side is tested by undoing their merges, latest first, and looking for a merge across the border that would have
come before. Work grows in proportion to the text, also for words of any length.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pixelloom.llm.common import holds, others, slices, turn_to

#: Fixed by the vocabulary's file: the word-end mark, the pre-token pattern, and the strings taken as whole tokens.
WORD_END = "</w>"
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
#: White space to Python's split() that isn't to Unicode.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
SPACES = regex.compile(r"\p{White_Space}+")
#: Bytes of text to an output batch, and words in a cache generation (two generations are held).
OUT_BYTES, CACHE_WORDS = 4 << 20, 150_000
MARK = "\n"  # stands for the word end; never a byte's character
#: Characters each of which PRE_TOKEN takes in one run, apart from a word before them.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Pairs of tokens whose test is kept.
PAIRS = 200_000
#: Characters of a short word, and how many prefixes of short words are kept.
SHORT, PREFIXES = 48, 100_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Bpe:
    """An encoder and decoder for the word-end kind of BPE file, exact to the id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab: dict[str, int] = data["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.strings = [""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for s, i in [*vocab.items(), *self.specials.items()]:
            self.strings[i] = s
        #: For each token the two that its merge joins and the merge's rank, -1 without one; by pair of tokens (left << 20 | right) the rank.
        self.left, self.right, self.rank = ([-1] * len(self.strings) for _ in range(3))
        self.merged: dict[int, int] = {}
        for r, (a, b) in enumerate(data["model"]["merges"]):
            i, x, y = vocab[a + b], vocab[a], vocab[b]
            self.merged[x << 20 | y] = r
            if self.rank[i] < 0:
                self.left[i], self.right[i], self.rank[i] = x, y, r
        known: dict[int, bool] = {}
        marked = ((s[: -len(WORD_END)] + MARK if s.endswith(WORD_END) else s, i) for s, i in vocab.items())
        self.words = {s: i for s, i in marked if self._reachable(i, known)}  # others never occur in an encoding
        self.ids = [i.to_bytes(4, "little") for i in range(len(self.strings))]
        self.fits: dict[int, bool] = {}
        #: Reads a text backwards and recognises the tokens that are its suffixes: {character: next state, "": these tokens, the longest first, as
        #: (token, characters)}.
        self.automaton: dict = {}
        for s, i in sorted(self.words.items(), key=lambda w: len(w[0])):
            state, shorter = self.automaton, ()
            for c in reversed(s):
                state = state.setdefault(c, {})
                shorter = state.get("", shorter)
            state[""] = ((i, len(s)), *shorter)
        self.table = str.maketrans({b: c for b, c in enumerate(byte_characters())})
        self.prefixes: dict[str, tuple[int, bytes] | None] = {}
        self.seen = Seen(self, {})

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of left's and right's text, joined, is left and right."""
        a, b, limit = left, right, len(self.merged)
        merged, rank = self.merged, self.rank
        while True:
            if merged.get(a << 20 | b, limit) < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:
                limit, a = ra, self.right[a]
            elif rb >= 0:
                limit, b = rb + 1, self.left[b]  # of equal merges the left one comes first
            else:
                return True

    def _reachable(self, token: int, known: dict[int, bool]) -> bool:
        """Whether the encoding of the token's text is the token: its two parts, each reachable, must meet by the last merge of all."""
        if token not in known:
            a, b, last = self.left[token], self.right[token], self.rank[token]
            known[token] = last < 0 or self._reachable(a, known) and self._reachable(b, known) and self._only(a, b, last)
        return known[token]

    def _only(self, a: int, b: int, last: int) -> bool:
        """No merge crosses the border of a and b before their own, last, does."""
        limit = last + 1
        if self.merged.get(a << 20 | b, limit) != last or max(self.rank[a], self.rank[b]) > last:
            return False
        x, y = a, b
        while True:
            rx, ry = self.rank[x], self.rank[y]
            if rx > ry:
                limit, x = rx, self.right[x]
            elif ry >= 0:
                limit, y = ry + 1, self.left[y]
            else:
                return True
            if self.merged.get(x << 20 | y, limit) < limit:
                return False

    def word(self, pre_token: str) -> bytes:
        """Ids of one pre-token, as little-endian 32-bit integers."""
        s = (pre_token if pre_token.isascii() and pre_token.isprintable() else pre_token.encode("utf-8", "replace").decode("latin-1").translate(self.table)) + MARK
        if (i := self.words.get(s)) is not None:  # a reachable token is the encoding of its own text
            return self.ids[i]
        if len(s) > SHORT:
            return self._long(s)
        if len(self.prefixes) > PREFIXES:
            self.prefixes = {}
        return self._encoding(s)[1]

    def _long(self, s: str) -> bytes:
        """last[end] is the token that ends the encoding of the prefix up to end. It is worked out only for prefixes that are asked for: first
        the whole word, then those that a candidate for its last token leaves; a stack holds the prefixes that wait for another's answer.
        """
        fits = self.fits
        last: dict[int, tuple[int, int] | None] = {}  # with its characters; None where only the word-end mark is left, which alone isn't a token
        stack: list[tuple[int, list[tuple[int, int]]]] = []
        end, left = len(s), None
        while True:
            if left is None:
                left = list(reversed(self._suffixes(s, end)))
            answer = None
            while left:
                token, n = left[-1]
                start = end - n
                if start:
                    if start not in last:
                        break
                    left.pop()
                    before = last[start]
                    if before is None:
                        continue
                    pair = before[0] << 20 | token
                    ok = fits.get(pair)
                    if not (self._fit(pair, before[0], token) if ok is None else ok):
                        continue
                answer, left = (token, n), None
                break
            if left:  # waits for the prefix before left[-1]
                stack.append((end, left))
                end, left = start, None
                continue
            last[end] = answer
            if not stack:
                break
            end, left = stack.pop()
        ids, at = [], len(s)
        while at:
            token, n = last[at]
            ids.append(self.ids[token])
            at -= n
        ids.reverse()
        return b"".join(ids)

    def _suffixes(self, s: str, end: int) -> tuple[tuple[int, int], ...]:
        """The tokens that are suffixes of the prefix up to end, the longest first."""
        node, found = self.automaton, ()
        while end and (node := node.get(s[end - 1])) is not None:
            end -= 1
            found = node.get("", found)
        return found

    def _encoding(self, p: str) -> tuple[int, bytes] | None:
        """The last token and the ids of a short word's beginning, or of the word. What holds for a prefix holds in every word that begins so, and is
        kept over words."""
        node, found = self.automaton, ()
        for c in reversed(p):
            node = node.get(c)
            if node is None:
                break
            found = node.get("", found)
        answer, known, fits = None, self.prefixes, self.fits
        for token, n in found:
            if n == len(p):
                answer = token, self.ids[token]
                break
            q = p[:-n]
            before = known.get(q, False)
            if before is False:
                before = self._encoding(q)
            if before is None:
                continue
            pair = before[0] << 20 | token
            ok = fits.get(pair)
            if self._fit(pair, before[0], token) if ok is None else ok:
                answer = token, before[1] + self.ids[token]
                break
        if p[-1] != MARK:
            known[p] = answer
        return answer

    def _fit(self, pair: int, before: int, token: int) -> bool:
        if len(self.fits) > PAIRS:
            self.fits.clear()
        ok = self.fits[pair] = self.compatible(before, token)
        return ok

    def chunk(self, s: str) -> bytes:
        """Ids, as little-endian 32-bit integers, of a piece of normalised text without white space or special tokens."""
        if s.isalpha():
            return self.word(s)
        stem = s.rstrip(PUNCTUATION)
        if len(stem) < len(s) and stem.isalpha():  # a word and a run of punctuation, the most frequent by far
            return self.seen[stem] + self.seen[s[len(stem) :]]
        return b"".join(map(self.word, PRE_TOKEN.findall(s)))

    def pieces(self, text: str) -> list[bytes]:
        """The ids of each stretch of text between white space, in order."""
        if "<|" in text and self.special.search(text):
            out, at = [], 0
            for m in self.special.finditer(text):
                out += self.pieces(text[at : m.start()])
                out.append(self.specials[m[0]].to_bytes(4, "little"))
                at = m.end()
            return out + (self.pieces(text[at:]) if at < len(text) else [])
        text = unicodedata.normalize("NFC", text)
        text = (text.replace("Σ", "σ") if "Σ" in text else text).lower()
        words = [w for w in SPACES.split(text) if w] if ODD_SPACE.search(text) else text.split()
        if len(self.seen) > CACHE_WORDS:
            self.seen = Seen(self, dict(self.seen))
        return list(map(self.seen.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers; null as empty."""
        return b"".join(self.pieces(text)) if text else b""

    def decode(self, ids: bytes) -> str:
        """The tokens' strings, a space between each two, as the file has no decoder."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Seen(dict):
    """Ids of the stretches of text seen lately: this generation and the one before."""

    def __init__(self, bpe: Bpe, old: dict[str, bytes]):
        super().__init__()
        self.bpe, self.old = bpe, old

    def __missing__(self, s: str) -> bytes:
        ids = self.old.get(s)
        if ids is None:
            ids = self.bpe.chunk(s)
        if len(s) <= 64:
            self[s] = ids
        return ids


@lru_cache(maxsize=2)
def _model(path: str) -> Bpe:
    return Bpe(path)


def model(path: str) -> Bpe:
    """One model for each worker process and file; asked for at a task's start."""
    turn_to("bpe")
    return _model(path)


holds("bpe", _model.cache_clear)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df without its column text, plus ids (binary: little-endian unsigned 32-bit integers) and, if asked for, the decoded text.

    Null texts count as empty: ids without bytes. Rows are independent: repeated rows, empty tables and other columns need no care, but a
    column named ids (or decoded), in any case, is replaced. Special tokens are not added; their strings in a text become their ids. Whole texts are read,
    in batches; nothing is shuffled.
    """
    keep = others(df, [text, ids, decoded])
    add = f"{ids} binary" + (f", {decoded} string" if decoded else "")
    schema = df.select(*keep).schema
    for name, kind in (x.split() for x in add.split(", ")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            texts = batch.column(len(keep))
            for a, b in slices(texts, OUT_BYTES):
                found = [bpe.encode(t) for t in texts.slice(a, b - a).to_pylist()]
                columns = [batch.column(i).slice(a, b - a) for i in range(len(keep))] + [pa.array(found, pa.binary())]
                if decoded:
                    columns.append(pa.array([bpe.decode(x) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, ids, *([decoded] if decoded else [])])

    return df.select(*keep, text).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """df without its column ids, plus the decoded text; null ids give null. Otherwise as encode()."""
    keep = others(df, [ids, text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            found = batch.column(len(keep))
            for a, b in slices(found, OUT_BYTES):
                texts = [None if x is None else bpe.decode(x) for x in found.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(keep))] + [pa.array(texts, pa.string())], names=[*keep, text])

    return df.select(*keep, ids).mapInArrow(run, df.select(*keep).schema.add(text, "string"))
