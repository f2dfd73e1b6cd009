"""Byte-level BPE encoding and decoding by monoid tree reduction.

Encodings of neighbouring pieces of a text form a monoid.  A text is halved
down to small leaves, leaves are encoded, and two neighbours are joined by
re-encoding a window about their border only.  The window grows, in doublings,
until what lies outside it provably can't change: both its edges are places
that no match of the split pattern crosses, whatever stands around them (a
space or line break right after a character that isn't white space).  Matches
left of such a place never look beyond it and matches right of it never look
back, and merges stay within a match, so the tokens outside are final.  A text
without such places is re-encoded up to its ends.

Decoding concatenates bytes up the same kind of tree.

Defined cases: a null text is an empty one and has no tokens; repeated rows
have equal results; an empty table gives an empty result; special tokens are
ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lautwerk.llm.common import texts_of

#: Code points of a leaf, and of the first window on either side of a border.
LEAF, WINDOW = 2048, 32

#: A border that no match of the split pattern crosses.
_SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85​﻿])(?=[ \n])")

_CODECS: dict = {}


class Codec:
    """Ranks from a file, a split pattern, and the tree on top of a leaf encoder."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        size = max(ranks.values()) + 1
        self.bytes_of, self.text_of = [b""] * size, [b"%d" % i for i in range(size)]
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.encode_leaf = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.leaf, self.window = leaf, max(1, window)

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, low: int, high: int) -> list[int]:
        if high - low <= self.leaf:
            return self.encode_leaf(text[low:high])
        middle = (low + high) // 2
        left, right = self._encode(text, low, middle), self._encode(text, middle, high)
        return self.join(text, low, middle, high, left, right)

    def join(self, text: str, low: int, middle: int, high: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of text[low:high] from those of its two parts."""
        if _SAFE.match(text, middle) and middle > low:
            return left + right
        width = self.window
        while True:
            a = self._edge_left(text, low, middle, width)
            b = self._edge_right(text, middle, high, width)
            if a is not None and b is not None:
                break
            width *= 2
        new = self.encode_leaf(text[a:b])
        keep = self._prefix(left, len(text[a:middle].encode("utf-8", "replace")))
        skip = self._suffix(right, len(text[middle:b].encode("utf-8", "replace")))
        if keep is None or skip is None:  # an edge is inside a token: only possible next to lone surrogates
            return self.encode_leaf(text[low:high])
        return left[:keep] + new + right[skip:]

    def _edge_left(self, text: str, low: int, middle: int, width: int) -> int | None:
        """The last safe border at least one and at most ``width`` code points before the middle; low once the window reaches it."""
        at = max(low, middle - width)
        found = None
        for m in _SAFE.finditer(text, max(at, 1), middle):
            if m.start() > low:
                found = m.start()
        return found if found is not None else low if at == low else None

    def _edge_right(self, text: str, middle: int, high: int, width: int) -> int | None:
        end = min(high, middle + width)
        m = _SAFE.search(text, middle + 1, end)
        while m and m.start() <= middle:
            m = _SAFE.search(text, m.start() + 1, end)
        return m.start() if m and m.start() < high else high if end == high else None

    def _prefix(self, tokens: list[int], n_bytes: int) -> int | None:
        """How many tokens stay if the last n_bytes go; None if that cuts one."""
        k = len(tokens)
        while n_bytes > 0 and k:
            k -= 1
            n_bytes -= len(self.bytes_of[tokens[k]])
        return k if n_bytes == 0 else None

    def _suffix(self, tokens: list[int], n_bytes: int) -> int | None:
        """How many tokens go if the first n_bytes go; None if that cuts one."""
        k = 0
        while n_bytes > 0 and k < len(tokens):
            n_bytes -= len(self.bytes_of[tokens[k]])
            k += 1
        return k if n_bytes == 0 else None

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 1 << 16:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def codec(path: str, pattern: str) -> Codec:
    """One per Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with an array of token ids."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        return pa.array([c.encode(t or "") for t in texts_of(texts)], pa.list_(pa.int32()))

    return docs.withColumn(out, ids(F.col(text)))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that an array of token ids stands for."""

    @F.arrow_udf("binary")
    def back(tokens: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        return pa.array([c.decode(t or []) for t in texts_of(tokens)], pa.binary())

    return docs.withColumn(out, back(F.col(ids)))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes each text; ids and bytes don't leave the worker."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(texts: pa.Array) -> pa.Array:
        c, sha = codec(path, pattern), hashlib.sha256
        count, ids_sha, out_sha = [], [], []
        shown = c.text_of.__getitem__
        for t in texts_of(texts):
            ids = c.encode(t or "")
            count.append(len(ids))
            ids_sha.append(sha(b" ".join(map(shown, ids))).hexdigest())
            out_sha.append(sha(c.decode(ids)).hexdigest())
        return pa.StructArray.from_arrays(
            [pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())],
            names=["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    out = docs.select("doc_id", both(F.col("text")).alias("d"))
    return out.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
