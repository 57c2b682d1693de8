"""What the text operators share: words, folds and sums of arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import materialise


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, then the runs without ASCII white space (`[^\\x20\\x09-\\x0D]+`); bytes.split knows exactly those."""
    return text.lower().split()


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds by which rows are held out."""
    return (F.crc32(id_col.cast("string").cast("binary")) % n).cast("int")


def raw_text(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """The columns named, and the text as bytes (null: empty)."""
    return docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_text"))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def table_batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(n).type) for n, c in cols.items()]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def sum_arrays(df: DataFrame, keys: list[str], fan: int = 64) -> DataFrame:
    """Element-wise sums of the float64 arrays packed in column `packed` by `keys`, in three levels.

    A group of the first two levels has the arrays of `fan` partitions, or of `fan` groups, so with a few arrays from each
    partition no group is large before there are `fan` ** 3 partitions."""
    kinds = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf["packed"].iloc[0]).copy()
        for x in pdf["packed"].iloc[1:]:
            total += np.frombuffer(x)
        own = [n for n in pdf.columns if n != "packed"]
        return pdf[own].iloc[:1].assign(packed=[total.tobytes()])

    df = df.select(*keys, F.floor(F.spark_partition_id() / fan).cast("int").alias("_group"), "packed")
    df = df.groupBy(*keys, "_group").applyInPandas(add, f"{kinds}, _group int, packed binary")
    df = df.withColumn("_group", F.floor(F.col("_group") / fan).cast("int"))
    df = df.groupBy(*keys, "_group").applyInPandas(add, f"{kinds}, _group int, packed binary").drop("_group")
    return df.groupBy(*keys).applyInPandas(add, f"{kinds}, packed binary")


def looked_up(rows: DataFrame, table: DataFrame, key: str, n: str, total: int, share: int = 1000) -> DataFrame:
    """`rows` joined with `table`, which has one row for each key and in column `n` how many of the `total` rows have it.

    Keys on over a `share`-th of the rows, fewer than `share` of them, are looked up in a broadcast, so no task gets all rows
    of a hot key; the others are shuffled."""
    often = F.broadcast(materialise(table.where(F.col(n) > total / share), "often"))
    seldom = rows.join(often.select(key), key, "left_anti").join(table.where(F.col(n) <= total / share), key)
    return rows.join(often, key).unionByName(seldom).drop(n)


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as no column of `docs` has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_columns(docs: DataFrame, fields: list[tuple[str, str]], start, text_col: str = "text") -> DataFrame:
    """`docs` with further columns, `(name, type)`, that are made from each row's whole text in the task that reads it.

    `start()` gives, once for each task, a function from a list of texts (as bytes) to the arrays of those columns."""
    kinds = T.StructType([*docs.schema.fields, *(T.StructField(n, T._parse_datatype_string(k)) for n, k in fields)])

    def run(batches):
        made = start()
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made(texts)], [*b.schema.names[:-1], *(n for n, _ in fields)])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select("*", text.alias(free_name(docs, "_bytes"))).mapInArrow(run, kinds)
