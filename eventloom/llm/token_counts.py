"""Token counts by a SentencePiece model: Arrow functions that return lengths only.

Texts are cut into parts at safe boundaries, the parts of many texts are put into batches of about the
same number of bytes, and only the number of ids of each part comes back and is summed for its text.

A boundary before a space is safe if a printable ASCII character other than the space stands on either
side of the space: no piece of the vocabulary holds the space mark after another character (checked
when the model is loaded), so no merge crosses the boundary, and as the model puts a space mark before
each text it gets, the space itself is left out. If a model lacks one of these properties, its texts
are never cut.

A null or empty text has no tokens. Repeated rows give repeated counts; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from eventloom.llm.bpe import _schema_of
from eventloom.llm.common import ship, strings

#: Characters of a part, bytes of a batch, tokens over which a document is too long.
PART_CHARS, BATCH_BYTES, LIMIT = 4096, 1 << 20, 4096
SPACE = "▁"
SAFE = re.compile(r"(?<=[!-~]) (?=[!-~])")


class Counter:
    def __init__(self, path: str, part_chars: int = PART_CHARS, batch_bytes: int = BATCH_BYTES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        one, two = self.model.encode("a", out_type=str), self.model.encode("  a", out_type=str)
        marks = lambda x: len("".join(x)) - len("".join(x).lstrip(SPACE))
        self.can_cut = not any(SPACE in p.lstrip(SPACE) for p in pieces) and marks(one) == 1 and marks(two) == 3
        self.part_chars, self.batch_bytes = max(1, part_chars), batch_bytes

    def parts(self, text: str) -> list[str]:
        """Texts whose counts sum to that of text; no longer than part_chars wherever there are safe boundaries."""
        if len(text) <= self.part_chars or not self.can_cut:
            return [text]
        out, start = [], 0
        while len(text) - start > self.part_chars:
            cut = SAFE.search(text, start + self.part_chars - 1)
            if cut is None:
                break
            out.append(text[start : cut.start()])
            start = cut.end()
        return [*out, text[start:]]

    def counts(self, texts: Sequence[str]) -> list[int]:
        total = [0] * len(texts)
        batch, owners, size = [], [], 0
        for owner, text in enumerate(texts):
            for part in self.parts(text) if text else ():
                batch.append(part)
                owners.append(owner)
                size += len(part) if part.isascii() else len(part.encode())
                if size >= self.batch_bytes:
                    self._add(total, batch, owners)
                    batch, owners, size = [], [], 0
        self._add(total, batch, owners)
        return total

    def _add(self, total: list[int], batch: list[str], owners: list[int]) -> None:
        if batch:
            for owner, ids in zip(owners, self.model.encode(batch, num_threads=1), strict=True):
                total[owner] += len(ids)


@lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """The columns `keep`, n_bytes, n_tokens, over_limit (more than `limit` tokens)."""
    path = model or default_model()
    ship(df.sparkSession)
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        own = counter(path)
        for batch in batches:
            texts = strings(batch.column(len(keep)))
            sizes = pc.binary_length(texts).to_numpy()
            # rows of one call are taken by bytes, so that a run of long texts doesn't make a large one
            ends, held = [], 0
            for i, size in enumerate(sizes):
                held += int(size)
                if held >= 4 * own.batch_bytes:
                    ends.append(i + 1)
                    held = 0
            counts: list[int] = []
            low = 0
            for high in [*ends, len(sizes)]:
                counts += own.counts(texts[low:high].to_pylist())
                low = high
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], [*keep, "n_bytes", "n_tokens", "over_limit"])

    return df.select(*keep, df[text].alias("__text")).mapInArrow(run, _schema_of(df, keep, "n_bytes bigint, n_tokens bigint, over_limit boolean"))
