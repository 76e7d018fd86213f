"""What the operators of this subpackage share: tables, the shared work folder, words and shingles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    One of our own only where none is named and all run on this machine (master local); else an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-work-"))
    return _own_dir[0]


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: what follows no longer depends on what came before.

    A lost executor then costs a re-read of files, not a re-run of the lineage, and several readers share one run.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that may hold more than this part of all rows; so many rows are broadcast at most.
MOST_HOT = 10_000


def join_hot(rows: DataFrame, side: DataFrame, key: str, total: int, weight: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with side, which has one row for each key and in `weight` how many of the `total` rows hold the key.

    Keys with more than total / MOST_HOT rows, of which there are fewer than MOST_HOT, meet their rows where these are;
    only the others are shuffled, so no task gets all rows of a hot key. how: inner or left. weight is not returned.
    """
    least = total // MOST_HOT
    hot, cold = side.where(F.col(weight) > least).drop(weight), side.where(F.col(weight) <= least).drop(weight)
    met = rows.join(F.broadcast(hot), key)
    out = met.unionByName(rows.where(F.col(key).isNotNull()).join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how))
    if how == "left":  # null keys meet nothing and stay where they are
        out = out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)
    return out


def drop_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in ids (one column); rows with a null id stay, and stay where they are. No column name
    can clash."""
    name = f"id_{uuid.uuid4().hex}"
    gone = ids.toDF(name).where(F.col(name).isNotNull()).distinct()
    named = docs.where(docs[id_col].isNotNull())
    return named.join(gone, named[id_col] == F.col(name), "left_anti").union(docs.where(docs[id_col].isNull()))


def text_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so that other columns can't clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it, also within lambdas."""
    return F.transform(F.array(value), use)[0]


# --- words and shingles -------------------------------------------------------------------------

_MASK = (1 << 64) - 1
#: Odd multiplier of the rolling shingle code (golden ratio times 2**64).
_ROLL = np.uint64(0x9E3779B97F4A7C15)


class _WordCodes(dict):
    """word bytes -> 64-bit code; keeps the codes of at most `bound` words, so that memory stays bounded."""

    bound = 200_000

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.bound:
            self[word] = code
        return code


_codes = _WordCodes()


def words(text: bytes | None) -> list[bytes]:
    """Maximal runs without ASCII white space, A-Z lower-cased: what bytes.lower() and bytes.split() do."""
    return text.lower().split() if text else []


def shingle_set(text: bytes | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit codes of the k-word shingles; fewer words: the whole sequence as one; no words: none."""
    w = words(text)
    n = len(w)
    if not n:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(_codes.__getitem__, w), np.uint64, n)
    if n < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=n)], np.uint64)
    s = codes[: n - k + 1].copy()
    for i in range(1, k):
        s *= _ROLL
        s += codes[i : n - k + 1 + i]
    return np.unique(s)


def byte_lists(column) -> Iterable[bytes | None]:
    """An Arrow string column as bytes, without decoding."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()
