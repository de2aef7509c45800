"""Rows to rows in Arrow batches."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Bytes of rows that go to Python at a time: Spark holds them about four times, in vectors that double as they grow.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers Spark's bound of 64 MiB a batch; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = re.fullmatch(r"(-?\d+)b?", spark.conf.get(key))
    if bound and not 0 < int(bound[1]) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def each_row(df: DataFrame, keys: list[str], inputs: list[str], schema: str, arrow: pa.Schema, make) -> DataFrame:
    """make(*inputs) -> rows after the keys, for each row of df."""
    types = dict(df.dtypes)
    bounded_batches(df.sparkSession)

    def run(source):
        for batch in source:
            take, rows = [], []
            for r, values in enumerate(zip(*((x.as_py() for x in c) for c in batch.columns[len(keys) :]), strict=True)):  # one row's at a time
                for row in make(*values):
                    take.append(r)
                    rows.append(row)
            which = pa.array(take, pa.int64())
            cols = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)] if rows else [pa.array([], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([c.take(which) for c in batch.columns[: len(keys)]] + cols, names=[*keys, *arrow.names])

    return df.select(*keys, *inputs).mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), schema]))
