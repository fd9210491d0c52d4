"""What the operators of this subpackage share: the folder that all executors see, and tokenizers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset and all work is done on this machine, as in tests, a temporary one is set for the
    session; on a cluster that is an error, as executors wouldn't see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        folder = tempfile.mkdtemp(prefix="noteforge-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Spark's setting to drop an execution's shuffle files at its end.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder as a table and read again: it cuts the lineage, and is there though executors are lost.

    The shuffle files of the write aren't needed after it and go at once; the table goes by `discard` or when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    try:
        spark.conf.set(_CLEAN, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    files, where = _files(spark, path)
    files.deleteOnExit(where)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def discard(table: DataFrame) -> None:
    """Deletes a table made by `written` that nothing reads any more."""
    files, where = _files(table.sparkSession, table._written_to)
    files.delete(where, True)


_TOKENIZERS: dict[str, object] = {}


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Number of tokens of each text under the tokenizer in a file: `*.json`, `*.tiktoken` or `*.model`. Loaded once a process."""
    if path not in _TOKENIZERS:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            _TOKENIZERS[path] = lambda xs: [len(e) for e in t.encode_batch_fast(xs, add_special_tokens=False)]
        elif path.endswith(".model"):
            import sentencepiece

            t = sentencepiece.SentencePieceProcessor(model_file=path)
            _TOKENIZERS[path] = lambda xs: [len(e) for e in t.encode(xs, num_threads=1)]
        else:
            import base64

            import public_tokenizers
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
            t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            _TOKENIZERS[path] = lambda xs: [len(t.encode_ordinary(x)) for x in xs]
    return _TOKENIZERS[path](texts)
