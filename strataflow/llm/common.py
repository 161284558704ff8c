"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases ASCII letters only, on UTF-8 bytes.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new one for a session that
    runs on this machine alone (tests); on a cluster that is an error, since executors wouldn't see it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="strataflow-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Files a core of a table of short rows.
FILES_A_CORE = 3


def written(df: DataFrame, name: str, slim: bool = False, **options) -> DataFrame:
    """df as a table in the shared folder: lineage ends here and a lost executor loses nothing.

    slim: its rows are short, so it goes to no more than FILES_A_CORE files a core, however many partitions it has. options: of
    the writer."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    (df.coalesce(FILES_A_CORE * spark.sparkContext.defaultParallelism) if slim else df).write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strataflow_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._strataflow_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, n: int | None = None) -> DataFrame:
    """Rows dealt evenly, however few files or row groups they came from."""
    return df.repartition(n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(column, modulus: int):
    """crc32 of the id as text, mod modulus (null id: the empty text)."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def id_crc(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def kept_rows(docs: DataFrame, keep, text: str = "text") -> DataFrame:
    """The rows of docs, whole, whose text passes: keep takes a list of texts (None for null) and gives booleans."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ok = keep(b.column(b.schema.get_field_index(text)).to_pylist())
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def text_scores(docs: DataFrame, score, columns: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the columns that score makes: it takes a list of texts and gives one list a column."""
    import pyarrow as pa

    names = [c.split()[0] for c in columns.split(",")]
    kinds = [{"double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in columns.split(",")]

    def run(batches):
        for b in batches:
            made = [pa.array(x, k) for x, k in zip(score(b.column(1).to_pylist()), kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], ["doc_id", *names])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(run, f"doc_id {kind}, {columns}")


def least_hashed(rows: DataFrame, n: int, *columns: str) -> DataFrame:
    """At most n rows, the same ones each time: those with the least hash of the columns."""
    return rows.orderBy(F.xxhash64(*columns), *columns).limit(n)


class BoundedCache(dict):
    """word -> what `make` gives, for at most two halves of `size` entries."""

    def __init__(self, make, size: int = 1 << 17):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
