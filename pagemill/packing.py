"""One packed row a page between Python and the JVM.

Row functions give a list of small tuples a page. They travel as one array<struct> a page, so repeated
deliveries of a page are removed by one aggregation of one row a page, not of one row a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "smallint": pa.int16(), "boolean": pa.bool_()}


def once(f, kind: str):
    """An Arrow function that the optimiser neither repeats in inferred filters nor pushes below a shuffle: it is declared
    nondeterministic, though it isn't."""
    return F.arrow_udf(f, kind).asNondeterministic()


def packed(ids: list, rows: list[list[tuple]], fields: dict[str, str], key: str) -> pa.RecordBatch:
    """ids and their tuples as a batch of key and units array<struct<fields>>."""
    offsets, n = [0], 0
    for r in rows:
        n += len(r)
        offsets.append(n)
    flat = [t for r in rows for t in r]
    columns = list(zip(*flat)) if flat else [[] for _ in fields]
    struct = pa.StructArray.from_arrays([pa.array(c, ARROW[t]) for c, t in zip(columns, fields.values())], list(fields))
    units = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), units], [key, "units"])


def map_units(df: DataFrame, key: str, fields: dict[str, str], make: Callable[[], Callable[..., list[tuple]]]) -> DataFrame:
    """Apply a row function to df(key, columns…); make() runs once a task and gives f(*columns) -> tuples.

    The key must be bigint. Rows without a result are left out.
    """
    inner = ",".join(f"{n}:{t}" for n, t in fields.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                columns = [c.to_pylist() for c in part.columns]
                ids, rows = [], []
                for i, *values in zip(*columns):
                    if out := f(*values):
                        ids.append(i)
                        rows.append(out)
                if ids:
                    yield packed(ids, rows, fields, key)

    return df.mapInArrow(run, f"{key} bigint, units array<struct<{inner}>>")


def unpack(df: DataFrame, key: str) -> DataFrame:
    """Distinct rows of packed units. Identical payloads of a key collapse before the shuffle; null keys are spread by payload."""
    salted = df.withColumn("_salt", F.when(F.col(key).isNull(), F.xxhash64("units")))
    sets = salted.groupBy(key, "_salt").agg(F.collect_set("units").alias("_sets"))
    units = F.when(F.size("_sets") == 1, F.get("_sets", F.lit(0))).otherwise(F.array_distinct(F.flatten("_sets")))
    flat = sets.select(key, F.inline(units))
    return flat
