"""Packing by power-of-two decomposition.

A document's ids, closed by an end id, are cut into full sequences and then
into pieces whose lengths are the powers of two of what remains, longest
first.  A piece is a sequence of its own, so no sequence crosses documents;
sequences of one length form a bucket, from which batches are drawn, and no
sequence has padding, as its length is a power of two.

Tokens come from a tokenizer file.  Its vocabulary works on words apart, so
each worker keeps the ids of the white-space chunks it has met.  Words of
letters only are encoded many at once, and their ids told apart by the tokens
that end a word; where these don't give as many words, each is encoded alone.
Pieces leave a worker as soon as a part of a batch is cut, so a batch's ids
are never held together.

Defined cases: a null or empty text has the end id only, one piece of length
1; repeated rows are packed each; an empty table gives an empty result;
sequence ids are unique, whatever the documents' ids are.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lautwerk.llm.common import slices

CAPACITY = 4096
END_ID = 2
#: Chunks, and words without marks at their end, that a worker remembers before it starts anew.
CACHE = 800_000
#: Documents whose pieces are put together at once.
PART = 256
#: Words of letters that are encoded as one text.
JOINED = 2048
#: How a token that ends a word is spelt.
END_OF_WORD = "</w>"
FIELDS = ("start", "length", "ids_crc32", "doc_tokens")
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_TOKENIZERS: dict = {}


class Words:
    """Ids of texts, chunk by chunk, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(END_OF_WORD)]] = True
        self.cache = cache
        self.known: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def ids(self, texts: list) -> list[bytes]:
        """Splits at plain spaces and line breaks only: the tokenizer drops white space and merges nothing across it."""
        chunks = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        if len(self.known) > self.cache:
            self.known.clear()
        if len(self.stems) > self.cache:
            self.stems.clear()
        self._learn(set(chain.from_iterable(chunks)).difference(self.known))
        return [b"".join(map(self.known.__getitem__, own)) for own in chunks]

    def _learn(self, fresh: set[str]) -> None:
        stems, parts, letters, others = self.stems, {}, set(), set()
        for c in fresh:
            # letters, then marks: the marks are a match of their own, unless normalising leaves a mark at the letters' end; letters are folded anyway
            word = c.rstrip(MARKS)
            plain = word.isascii() and word.isalpha() or word.lower().isalpha() and is_normalized("NFC", word)
            word, marks = (word, c[len(word) :]) if plain else (c, "")
            if word.isascii():
                word = word.lower()
            parts[c] = word, marks
            if word not in stems:
                (letters if plain else others).add(word)
            if marks and marks not in stems:
                others.add(marks)
        letters = list(letters)
        for k in range(0, len(letters), JOINED):
            self._joined(letters[k : k + JOINED])
        self._apart(list(others))
        self.known.update((c, stems[word] + stems[marks] if marks else stems[word]) for c, (word, marks) in parts.items())

    def _joined(self, letters: list[str]) -> None:
        """Each word has at least one match, so as many ends as words mean one match each."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        if len(ends) != len(letters):
            return self._apart(letters)
        raw = ids.tobytes()
        self.stems.update((w, raw[a:b]) for w, a, b in zip(letters, [0, *ends], ends))

    def _apart(self, fresh: list[str]) -> None:
        for k in range(0, len(fresh), JOINED):
            own = fresh[k : k + JOINED]
            got = self.tokenizer.encode_batch_fast(own, add_special_tokens=False)
            self.stems.update((c, array("I", e.ids).tobytes()) for c, e in zip(own, got))


def words(path: str, cache: int = CACHE) -> Words:
    """One per Python worker."""
    if (path, cache) not in _TOKENIZERS:
        _TOKENIZERS[path, cache] = Words(path, cache)
    return _TOKENIZERS[path, cache]


def pieces(total: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths: as many full sequences as fit, then the powers of two of the rest, longest first."""
    out = [capacity] * (total // capacity)
    rest = total % capacity
    out += [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return out


def cut(batches: Iterable[pa.RecordBatch], path: str, end_id: int, capacity: int, tokens: bool, cache: int) -> Iterator[pa.RecordBatch]:
    """Pieces of ``batches(doc_id, text)``, those of a few documents at a time."""
    close = np.array([end_id], "<u4").tobytes()
    for few in slices(batches, PART):
        start, length, crc, total, held, document = [], [], [], [], [], []
        for d, ids in enumerate(words(path, cache).ids(few.column("text").to_pylist())):
            ids += close
            n, at = len(ids) // 4, 0
            for size in pieces(n, capacity):
                part = ids[4 * at : 4 * (at + size)]
                document.append(d)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(part))
                total.append(n)
                at += size
                if tokens:
                    held.append(part)
        columns = [few.column("doc_id").take(pa.array(document, pa.int32())), *[pa.array(c, pa.int64()) for c in (start, length, crc, total)]]
        if tokens:
            ends = np.concatenate([[0], np.cumsum(np.array(length, np.int64))]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(held), "<i4"), pa.int32())
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *FIELDS, *(["tokens"] if tokens else [])])


def packed(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, tokens: bool = True, cache: int = CACHE) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, bucket, ids_crc32 and, if asked for, its ids.

    ``capacity`` is a power of two; ``cache`` bounds what a worker remembers, which costs no more than time.  Sequence ids join the partition's number
    and the row's place in it; the order of rows within a partition is that of
    the input, so a task that is run again gives the same ids.
    """
    own = docs.select("doc_id", "text")
    fields = [own.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in FIELDS]]
    if tokens:
        fields.append(T.StructField("tokens", T.ArrayType(T.IntegerType())))
    out = own.mapInArrow(lambda batches: cut(batches, path, end_id, capacity, tokens, cache), T.StructType(fields))
    return out.select(
        "doc_id", *FIELDS,
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.log2("length").cast("int").alias("bucket"),
        *(["tokens"] if tokens else []),
    )
