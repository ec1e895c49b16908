"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from wayfare.session import ensure_checkpoint_dir, sf_path

#: Largest object that an operator may ship to every task.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(sf_path(sf_dir, name))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder (survives a lost executor)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_broadcast(spark: SparkSession, obj, limit: int = BROADCAST_BYTES):
    """Broadcast ``obj`` after measuring it; refuse what is over ``limit`` bytes."""
    size = len(pickle.dumps(obj, protocol=pickle.HIGHEST_PROTOCOL))
    if size > limit:
        raise ValueError(f"{size} bytes to broadcast; the limit is {limit}")
    return spark.sparkContext.broadcast(obj)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as keep it apart from the columns of ``df``."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def by_row(df: DataFrame, columns: dict[str, str], schema: str,
           row: Callable[..., tuple], setup: Callable[[], object] | None = None) -> DataFrame:
    """Narrow Arrow map: ``row(state, *values)`` gives one output tuple per input row.

    ``columns`` maps an alias to the input column; only those columns are
    read, so extra columns of the input can never clash.  ``setup`` runs
    once a task.
    """
    fields = StructType.fromDDL(schema).fields
    names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            out = [row(state, *v) for v in zip(*cols)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=names)

    return df.select(*[F.col(f"`{c}`").alias(a) for a, c in columns.items()]).mapInArrow(run, schema)

