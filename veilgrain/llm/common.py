"""Helpers that the operators of this package share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain.workspace import Workspace

#: Ids are 8 bytes; so many of them, hashed, fit any executor and driver.
BROADCAST_IDS = 1_000_000


def held_out(doc_id: Column | str) -> Column:
    """True where crc32 of the id's decimal text leaves 2 modulo 4; a null id is never held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def map_texts(
    df: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[str | None], tuple]], fields: str
) -> DataFrame:
    """Apply ``make()``'s function to every whole text; one row out per row in, as ``id_col, *fields``.

    ``make`` runs once in each task. Texts go through one at a time, so memory
    is bounded by one Arrow batch and one result batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    types = StructType([df.schema[id_col], *_parse_datatype_string(fields).fields])
    schema = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            columns = list(zip(*(score(t.as_py()) for t in batch.column(1)), strict=True))
            if columns:
                arrays = [batch.column(0), *(pa.array(c, type=f.type) for c, f in zip(columns, list(schema)[1:], strict=True))]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    return df.select(id_col, text_col).mapInArrow(run, types)


def filter_texts(df: DataFrame, text_col: str, make: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """Rows whose text passes ``make()``'s predicate, all columns unchanged, without a shuffle."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            yield batch.filter(pa.array([keep(t.as_py()) for t in batch.column(at)], type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def without_ids(df: DataFrame, ids: DataFrame, id_col: str, ws: Workspace, name: str) -> DataFrame:
    """Rows of ``df`` whose id is not in ``ids``; rows with a null id stay.

    The ids are stored first and counted. Up to ``BROADCAST_IDS`` of them are
    sent to every executor, so the texts are not moved; beyond that both sides
    are shuffled by id and the ids are the hashed side.
    """
    gone = ws.write(ids.select(F.col(id_col).alias("_gone")).distinct(), name)
    small = gone.count() <= BROADCAST_IDS
    side = F.broadcast(gone) if small else gone.hint("shuffle_hash")
    return df.join(side, df[id_col] == side["_gone"], "left_anti")
