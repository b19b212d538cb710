"""Byte-level BPE encoding and decoding as a tree reduction.

A text is a product of its halves. A node of the tree is (text, ids of text); `join` gives the ids of
the product of two neighbours from the ids of each by encoding again only a window at their boundary.
The window grows until both of its ends are places where the ids cannot depend on what lies beyond:

* between pieces: the end is a cut that every match of the pattern respects, whatever surrounds it
  (`CUT`: a character that isn't white space before white space, a letter next to a digit, a letter
  before a sign, and so on). Matches on either side then see the same characters as before.
* within one long piece: the end lies between two tokens a, b for which encoding the bytes of a + b
  gives (a, b). A token sequence whose neighbours all have this property is the encoding of its bytes,
  so nothing outside the window changes.

Decoding concatenates bytes up the same kind of tree.

Null and empty texts have no tokens and decode to no bytes. Repeated rows give repeated results, an
empty table an empty one. Texts of any length are whole: only one text and its ids are held at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from eventloom.llm.common import ship, strings

#: Characters of a text, and bytes of a piece, that a leaf of the tree may have.
LEAF_CHARS, LEAF_BYTES = 4096, 512
#: Characters of the first window on either side of a boundary.
WINDOW = 16

CUT = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}])(?=\p{N})")


class TreeCodec:
    def __init__(self, path: str, pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES, window: int = WINDOW):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.leaf_chars, self.leaf_bytes, self.window = max(1, leaf_chars), max(1, leaf_bytes), max(1, window)
        self.library = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        self.bytes_of = [b""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(i) for i in range(size)]
        self._pairs = lru_cache(1 << 16)(self._pair_holds)

    # pieces: products of bytes

    def _pair_holds(self, a: int, b: int) -> bool:
        return self.library._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def piece(self, data: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        if len(data) <= self.leaf_bytes:
            return self.library._encode_single_piece(data) if data else []
        middle = len(data) // 2
        return self.join_piece(self.piece(data[:middle]), self.piece(data[middle:]))

    def join_piece(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of the product of two parts of one piece."""
        i = j = min(4, self.window)
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            first, last = len(left) - i, j
            ids = self.library._encode_single_piece(b"".join(map(self.bytes_of.__getitem__, left[first:] + right[:last])))
            before = first == 0 or not ids or self._pairs(left[first - 1], ids[0])
            after = last == len(right) or not ids or self._pairs(ids[-1], right[last])
            if before and after:
                return left[:first] + ids + right[last:]
            i, j = (i if before else 2 * i), (j if after else 2 * j)

    # texts: products of characters

    def _flat(self, text: str) -> list[int]:
        if len(text) <= self.leaf_chars:
            return self.library.encode_ordinary(text)
        out: list[int] = []
        for match in self.pattern.finditer(text):
            out += self.piece(match.group().encode())
        return out

    def _cut_before(self, text: str, start: int, end: int) -> int:
        """The last cut inside text[start:end] with a character on either side, else start."""
        width = self.window
        while True:
            low = max(start, end - width)
            found = -1
            for match in CUT.finditer(text, low + 1 if low > start else start + 1, end - 1):
                found = match.start()
            if found > start:
                return found
            if low == start:
                return start
            width *= 2

    def _cut_after(self, text: str, start: int, end: int) -> int:
        """The first cut inside text[start:end] with a character on either side, else end."""
        match = CUT.search(text, start + 1, end - 1)
        return match.start() if match and match.start() > start else end

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf_chars:
            return self.library.encode_ordinary(text[start:end])
        middle = (start + end) // 2
        return self.join(text, start, middle, end, self._encode(text, start, middle), self._encode(text, middle, end))

    def join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[start:end] from those of text[start:middle] and text[middle:end]."""
        low, high = self._cut_before(text, start, middle), self._cut_after(text, middle, end)
        drop = len(self._flat(text[low:middle])) if low > start else len(left)
        skip = len(self._flat(text[middle:high])) if high < end else len(right)
        return left[: len(left) - drop] + self._flat(text[low:high]) + right[skip:]

    def decode(self, ids: Sequence[int]) -> bytes:
        if len(ids) <= self.leaf_chars:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@lru_cache(4)
def codec(path: str, pattern: str) -> TreeCodec:
    return TreeCodec(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _schema_of(df: DataFrame, keep: list[str], more: str) -> str:
    return ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [more])


def encode(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """The columns `keep`, and ids array<int> of each text."""
    path, pattern = vocabulary or default_vocabulary()
    ship(df.sparkSession)
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(path, pattern)
        for batch in batches:
            texts = strings(batch.column(len(keep)))
            for low in range(0, len(texts), 512):
                ids = [tree.encode(t) for t in texts[low : low + 512].to_pylist()]
                own = [batch.column(i).slice(low, len(ids)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(ids, pa.list_(pa.int32()))], [*keep, "ids"])

    return df.select(*keep, df[text].alias("__text")).mapInArrow(run, _schema_of(df, keep, "ids array<int>"))


def decode(df: DataFrame, ids: str = "ids", keep: Sequence[str] = ("doc_id",), vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """The columns `keep`, and decoded binary. Null ids decode to no bytes."""
    path, pattern = vocabulary or default_vocabulary()
    ship(df.sparkSession)
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(path, pattern)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                out = [tree.decode(x or []) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(out, pa.binary())], [*keep, "decoded"])

    return df.select(*keep, df[ids].alias("__ids")).mapInArrow(run, _schema_of(df, keep, "decoded binary"))


def round_trip(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), vocabulary: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """Encodes and decodes in one pass: `keep`, n_tokens, ids_sha256, decoded_sha256; and ids array<int> if asked for (else they don't leave the Python worker)."""
    path, pattern = vocabulary or default_vocabulary()
    ship(df.sparkSession)
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = codec(path, pattern)
        sha = hashlib.sha256
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                counts, of_ids, of_bytes, every = [], [], [], []
                for value in part.column(len(keep)):
                    ids = tree.encode(value.as_py() or "")
                    counts.append(len(ids))
                    of_ids.append(sha(" ".join(map(tree.text_of.__getitem__, ids)).encode()).hexdigest())
                    of_bytes.append(sha(tree.decode(ids)).hexdigest())
                    if with_ids:
                        every.append(ids)
                columns = [*(part.column(i) for i in range(len(keep))), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(every, pa.list_(pa.int32()))] * with_ids, [*keep, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return df.select(*keep, df[text].alias("__text")).mapInArrow(run, _schema_of(df, keep, "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids))
