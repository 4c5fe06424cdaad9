"""Arrow plumbing for operators that run Python on the executors: small batches in, small batches out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

#: Bytes of text that are held as Python objects at once (a longer single text is held alone).
HOLD = 4_000_000


def pieces(batch: pa.RecordBatch, text: str, hold: int = HOLD) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about ``hold`` bytes of text (a longer single text alone)."""
    begin = held = 0
    for i, n in enumerate(pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()):
        if held and held + n > hold:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n + 1
    if begin < batch.num_rows:
        yield batch.slice(begin)


def slices(batch: pa.RecordBatch, text: str, hold: int = HOLD) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The pieces of ``batch``, with the texts; null becomes empty."""
    for part in pieces(batch, text, hold):
        yield part, [x or "" for x in part.column(text).to_pylist()]


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string; needs a session, so it is called on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def map_texts(docs: DataFrame, text: str, keep: list[str], fields: str, work: Callable[[list[str]], dict[str, list]]) -> DataFrame:
    """``keep`` columns and what ``work`` makes of the texts (columns of ``fields``, a DDL string)."""
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(fields)
    out = StructType([docs.schema[c] for c in keep] + made.fields)
    names = [f.name for f in made.fields]

    types = list(arrow_schema(fields).types)
    body = "_text"
    while body in keep:
        body += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, body):
                got = work(texts)
                arrays = [part.column(c) for c in keep] + [pa.array(got[n], type=t) for n, t in zip(names, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])
            # else the pool keeps what earlier batches and stages took of a worker's memory
            del batch, part, texts, got, arrays
            pa.default_memory_pool().release_unused()

    return docs.selectExpr(*[f"`{c}`" for c in keep], f"`{text}` as {body}").mapInArrow(run, out)
