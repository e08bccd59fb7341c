"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The whitespace characters of the contracts, [\x20\x09-\x0D].
WS = " \t\n\x0b\x0c\r"


def text_key(text: str | Column) -> Column:
    """64-bit hash of a text; with the id it tells rows that repeat an id apart. Null and empty text are the same."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


#: Rows of whole texts that a task hands to Python at once.
TEXT_ROWS = 500


def few_texts(df: DataFrame) -> DataFrame:
    """``df``, with a session that hands at most ``TEXT_ROWS`` rows to Python at once: its default of 10,000 whole texts can
    take gigabytes of an executor, outside its heap. A smaller setting of the user's stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= TEXT_ROWS:
        conf.set(name, TEXT_ROWS)
    return df


def docs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads, as ``doc_id`` and ``text`` (never null). Other columns, whatever their
    names, play no part."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole rows packed into one column ``row`` beside ``_id`` and ``_t``, so that a join cannot clash with their names."""
    return df.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), text_key(text_col).alias("_t"))


def same_doc(a: DataFrame, b: DataFrame) -> Column:
    """Join condition on ``_id`` (null equals null) and ``_t``."""
    return a["_id"].eqNullSafe(b["_id"]) & (a["_t"] == b["_t"])


def by_value(module: str) -> None:
    """Functions of this module go to the executors with their code, so those need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


class Known:
    """What a task remembers of words, by their bytes: emptied when it takes more than about ``most`` bytes."""

    def __init__(self, most: int = 24 << 20):
        # A plain dict: a set is compared with it in the set's time, with a subclass in the dict's.
        self.of: dict[bytes, int] = {}
        self.most, self.weight = most, 0

    def learn(self, wanted: set[bytes], make: Callable[[bytes], int]) -> None:
        """Makes sure that all of ``wanted`` are there."""
        new = wanted.difference(self.of)
        weigh = lambda ws: sum(map(len, ws)) + 170 * len(ws)  # noqa: E731  an entry takes its words' bytes, and so much besides
        if (more := self.weight + weigh(new)) > self.most:
            self.of.clear()
            new, more = wanted, weigh(wanted)
        self.of.update(zip(new, map(make, new), strict=True))
        self.weight = more


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``most`` bytes of ``column``, at least a row each."""
    ends = np.cumsum(pc.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def release() -> None:
    """Gives memory that a task has freed back to the system, as the worker lives on and the next stage needs its own."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def kept(key: str, make):
    """A value that the tasks of one worker share: functions that travel by value have no module of their own to keep it in."""
    store = sys.modules.setdefault("_cohortlens_worker", types.ModuleType("_cohortlens_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


by_value(__name__)
