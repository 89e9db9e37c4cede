"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.sources.tables import Scratch, shared_dir, written as stash  # noqa: F401

#: Words end at ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"
#: Text that Python handles at a time, in bytes: bounds a worker's memory whatever the batch holds.
SLICE_BYTES = 2 << 20


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(mod))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def native_rows(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices Arrow batches so that each holds about SLICE_BYTES of text (one row at least); null texts become empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > SLICE_BYTES:
                yield _piece(batch, column, start, i)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield _piece(batch, column, start, len(sizes))


def _piece(batch: pa.RecordBatch, column: pa.Array, start: int, end: int) -> tuple[pa.RecordBatch, list[bytes]]:
    texts = column.slice(start, end - start).cast(pa.binary()).to_pylist()
    return batch.slice(start, end - start), [t or b"" for t in texts]


def map_texts(df: DataFrame, keep: list[str], text: str, fn: Callable[[list[bytes]], dict], schema: str, setup: Callable | None = None) -> DataFrame:
    """Maps whole texts to columns in Arrow batches, next to the kept columns.

    fn takes the UTF-8 texts of a slice (and what setup returned, once a task) and returns arrays by name, as `schema` has them.
    """
    kept = df.select(*keep).schema
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields), schema])
    names = T.StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (setup(),) if setup else ()
        for piece, texts in native_rows(batches, text):
            got = fn(texts, *state)
            arrays = [piece.column(piece.schema.get_field_index(k)) for k in keep] + [pa.array(got[n]) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *names])

    return df.select(*keep, *([text] if text not in keep else [])).mapInArrow(run, out)
