"""SentencePiece encoding and decoding with a table of distinct chunks.

If no piece of the model holds a white-space marker after another character, no merge
crosses the start of a marked word: a text is segmented as the sequence of its marked
words (a run of markers and what follows).  Every task keeps a table of distinct marked
words; a word is segmented by the library when first met, and texts are put together from
the table by position.  The table is cleared at a bound, which changes no result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.llm.batches import bound_batches, give_back

MARK = "▁"
#: Most words in a task's table, and characters of a word that is kept there.
TABLE, LONGEST = 1 << 17, 200
#: Characters of text whose new words are segmented in one call.
BLOCK = 1 << 20
_SPACES = re.compile("(?<=[^ ]) (?= *)")


class Chunks:
    """Encodes texts by one model."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.separable = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and self.library.normalize(f"a  b{MARK} c") == f"{MARK}a{MARK}{MARK}b{MARK}{MARK}c"
        self.mark = array("I", [self.library.piece_to_id(MARK)]).tobytes()
        self.ids: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}
        self.bos = array("I", [self.library.bos_id()]).tobytes()
        self.eos = array("I", [self.library.eos_id()]).tobytes()

    def _learn(self, chunks: list[str]) -> None:
        found = self.library.encode(chunks, num_threads=1)
        for chunk, ids in zip(chunks, found, strict=True):
            # The library gives no id for an empty text, where the chunk is a lone marker.
            self.ids[chunk] = array("I", ids).tobytes() if chunk else self.mark
        if self.library.decode([i for ids in found for i in ids]) != " ".join([c for c in chunks if c]):
            self.odd |= {c: back for c, ids in zip(chunks, found, strict=True) if (back := self.library.decode(ids) if ids else "") != c}

    def _whole(self, text: str) -> tuple[bytes, str]:
        ids = self.library.encode(text, add_bos=True, add_eos=True)
        return array("I", ids).tobytes(), self.library.decode(ids)

    def _block(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        if len(self.ids) > TABLE:
            self.ids, self.odd = {}, {}
        texts = [x.replace(MARK, " ") for x in texts]
        split = [x.split(" ") for x in texts]
        split = [_SPACES.split(x) if "" in chunks else chunks for x, chunks in zip(texts, split, strict=True)]
        if new := sorted({c for chunks in split for c in chunks}.difference(self.ids)):
            self._learn(new)
        for text, chunks in zip(texts, split, strict=True):
            if not text:
                yield self.bos + self.eos, ""
                continue
            if self.odd:
                text = " ".join([self.odd.get(c, c) for c in chunks])
            yield b"".join((self.bos, *map(self.ids.__getitem__, chunks), self.eos)), text
        for c in new:
            if len(c) > LONGEST:
                del self.ids[c]
                self.odd.pop(c, None)

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text the ids with begin and end as little-endian 32-bit integers, and the decoded text."""
        if not self.separable:
            yield from map(self._whole, texts)
            return
        begin, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size > BLOCK:
                yield from self._block(texts[begin : i + 1])
                begin, size = i + 1, 0
        yield from self._block(texts[begin:])


def id_list(ids: Column) -> Column:
    """A binary column of ids as an array of integers."""

    def at(i: Column) -> Column:
        digits = F.hex(F.substring(ids, i * 4 + 1, F.lit(4)))
        return F.conv(F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("int")

    return F.transform(F.sequence(F.lit(0), (F.octet_length(ids) / 4).cast("int") - 1), at)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Begin and length of runs of texts of about BLOCK bytes."""
    begin, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        size += n
        if size > BLOCK:
            yield begin, i + 1 - begin
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts) - begin


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids (binary: begin, pieces, end as little-endian 32-bit integers) and decoded of every row of ``docs(doc_id, text)``.

    A null or empty text has the begin and end ids only and decodes to an empty text.
    ``model_file`` must be readable on every executor.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Chunks(model_file)
        for batch in batches:
            for begin, length in _slices(batch.column(1)):
                part = batch.slice(begin, length)
                rows = list(table.encode([x or "" for x in part.column(1).to_pylist()]))
                ids, back = pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, back], names=["doc_id", "ids", "decoded"])
        del table
        give_back()

    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def decode(encoded_rows: DataFrame, model_file: str) -> DataFrame:
    """doc_id and text of rows ``(doc_id, ids binary)``, by the library."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for ids in batches:
            yield pd.Series([library.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in ids], dtype=object)

    return encoded_rows.select("doc_id", text("ids").alias("text"))
