"""Copies of the small tables for edge cases: without rows, and with rows of nulls, repeated rows and columns of clashing names."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq

CLASHES = ["key", "label", "v", "a", "b", "r", "e", "l", "n", "q", "group", "count", "source_tokens", "_r", "_best", "rank", "split", "bundle", "pass", "block"]


def write(source: str, to: str, kind: str) -> str:
    os.makedirs(to, exist_ok=True)
    r = random.Random(3)
    for f in os.listdir(source):
        table = pq.read_table(f"{source}/{f}")
        if kind == "empty":
            table = table.slice(0, 0)
        elif not f.startswith(("sample_", "split_", "mix_")):
            again = table.take(pa.array(sorted(r.sample(range(table.num_rows), table.num_rows // 3))))
            nulls = pa.table({c: pa.nulls(5, t) for c, t in zip(table.schema.names, table.schema.types, strict=True)})
            table = pa.concat_tables([nulls, table, again])
            for c in CLASHES:
                if c not in table.schema.names:
                    table = table.append_column(c, pa.array([None, "x"] * (table.num_rows // 2) + [None] * (table.num_rows % 2), pa.string()))
        pq.write_table(table, f"{to}/{f}")
    return to
