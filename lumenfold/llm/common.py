"""What the training-data operators share: tables, written intermediate tables, byte words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lumenfold.operators.groups import lean, shared_dir, written

__all__ = ["LOWER", "LOWER_ALNUM", "bytes_of", "held_out", "map_batches", "shared_dir", "table", "text_bytes", "with_text", "written"]

#: bytes.translate table that lower-cases A-Z and leaves every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, and every ASCII byte that is neither a digit nor a letter becomes a space.
LOWER_ALNUM = bytes(32 if b < 128 and not (48 <= LOWER[b] <= 57 or 97 <= LOWER[b] <= 122) else LOWER[b] for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    """The text's UTF-8 bytes; Arrow then hands them to Python without decoding."""
    return F.col(column).cast("binary")


def with_text(docs: DataFrame, keep: list[str], text_col: str = "text") -> tuple[list, int]:
    """The columns of ``keep`` and the text, and the text's place among them: one that is kept anyway does not come twice. To be read by bytes_of."""
    if text_col in keep and docs.select(text_col).schema[0].dataType == StringType():
        return [*keep], keep.index(text_col)
    return [*keep, text_bytes(text_col).alias("_text_bytes")], len(keep)


def bytes_of(texts: pa.Array) -> list[bytes | None]:
    """Strings' UTF-8 bytes, without decoding."""
    return texts.cast(pa.binary()).to_pylist()


def held_out(id_column: str, folds: int, fold: int) -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == fold


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, most: int | None = None) -> DataFrame:
    """mapInArrow with a per-task set-up: ``make()`` returns the function of one batch, or of ``most`` rows of it at a time, so that what is made of them stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            for low in range(0, batch.num_rows, most or batch.num_rows):
                if (out := one(batch.slice(low, most or batch.num_rows))) is not None:
                    yield out

    return df.mapInArrow(lean(run), schema)
