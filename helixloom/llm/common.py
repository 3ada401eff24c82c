"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the ASCII controls from tab to carriage return.
WS_RE = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"
#: Keys of a few 64-bit numbers; a broadcast of so many takes about 30 MB.
BROADCAST_ROWS = 500_000
#: What a task reads of a table, about.
READ_BYTES = 32 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def words_of(col: Column) -> Column:
    """Words of a text: maximal runs without white space; a null text has none."""
    return F.array_remove(F.split(text_of(col), WS_RE), "")


def ascii_lower(col: Column) -> Column:
    return F.translate(text_of(col), UPPER, UPPER.lower())


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once for each row however often body uses it, also within its lambdas, and
    wherever the optimizer moves the expression (a column of an earlier projection can be copied into a lambda)."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def set_aside(df: DataFrame, prefix: str) -> tuple[DataFrame, dict[str, str]]:
    """df with the columns that begin with `prefix`, which an operator uses inside, renamed; and the new name of each column.
    `put_back` gives the columns their names again."""
    taken = {c.lower() for c in df.columns}
    names: dict[str, str] = {}
    for c in df.columns:
        new = c
        while new.lower().startswith(prefix) or (new != c and new.lower() in taken):
            new = "kept" + new
        taken.add(new.lower())
        names[c] = new
    return df.withColumnsRenamed({c: n for c, n in names.items() if c != n}), names


def put_back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({n: c for c, n in names.items() if c != n})


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset
    on a local master."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.helixloom.scratch", None)
    if not found:
        if not conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-helixloom-")
        spark.conf.set("spark.helixloom.scratch", found)
    return found.rstrip("/")


def sized(df: DataFrame, rows: int, each: int, *read: DataFrame) -> DataFrame:
    """df in no more partitions than `rows` of `each` make: small tables don't go through all shuffle partitions. `read` are written
    tables that df is made of: few rows may come from much, so there are partitions enough for READ_BYTES of each."""
    return df.coalesce(max(1, -(-rows // each), *[-(-size_of(x) // READ_BYTES) for x in read]))


def size_of(df: DataFrame) -> int:
    """Bytes of a table that `written` made."""
    files = df.inputFiles()
    if not files:
        return 0
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    return path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(*tables: DataFrame) -> None:
    """Delete tables that `written` made, once what was made of them is written itself."""
    for df in tables:
        files = df.inputFiles()
        if files:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def joined(df: DataFrame, keys: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """df joined with `keys`, a written table of distinct keys: broadcast if it has at most BROADCAST_ROWS rows, else both
    sides are shuffled."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, how)


def narrowed(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df whose key is in `keys`, as `joined` does it."""
    return joined(df, keys, on, "left_semi")
