"""Interface for operators on pixels: reading headers, detecting, embedding.

They need an image library or model weights, which are not part of this package. A caller gives a
function for a batch of rows; it runs once per Arrow batch with a session of its own per process, and
an error becomes a row, never a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

Work = Callable[[Any, dict[str, Any]], Iterable[dict[str, Any]]]


def per_row(rows: DataFrame, open_session: Callable[[], Any], work: Work, out: StructType, key: str) -> DataFrame:
    """What work yields for each row, with key and error; a row that raises gives one row with the error and nulls."""
    from pyspark.sql.pandas.types import to_arrow_schema

    full = StructType([rows.schema[key], *out.fields, StructField("error", StringType())])
    schema = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session = None
        for batch in batches:
            session = session or open_session()
            made: list[dict[str, Any]] = []
            for row in batch.to_pylist():
                try:
                    made += [{key: row[key], **x} for x in work(session, row)]
                except Exception as e:  # one bad file never ends a run
                    made.append({key: row[key], "error": f"{type(e).__name__}: {e}"[:500]})
            yield pa.RecordBatch.from_pylist(made, schema=schema)

    return rows.mapInArrow(run, full)
