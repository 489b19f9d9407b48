"""Token counts of documents in flat token files that have no index.

A flat file is nothing but token ids of fixed width, documents ended by a
separator id. Files are cut into blocks without regard to documents; each block
is read and compared with the separator as one array. A document that crosses
block borders is stitched together by a prefix scan over the blocks: the
separators before a block number its documents, and the last of them says
where the document that runs into the block began.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import files, texts
from textloom.llm.tokens import WordTokenizer
from textloom.plans.shared_dir import fresh_path, materialise

BLOCK_TOKENS = 1 << 20


def write_token_files(docs: DataFrame, tokenizer: str, separator: int, dtype: str = "<u2") -> tuple[DataFrame, DataFrame]:
    """Write the ids of ``docs(doc_id, text)`` as flat files in the shared folder.

    Returns ``(file, n_tokens)`` and ``(file, document, doc_id)``, the documents
    in file order; ids are integers. Null and empty texts are a separator alone. The separator
    must not be an id the tokenizer gives to text.
    """
    folder = fresh_path(docs.sparkSession, "token-files")

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordTokenizer.load(tokenizer, specials=False)
        path = files.attempt_path(folder, 0, ".bin")
        n, size = 0, 0
        with files.create(path) as out:
            for rows in source:
                for words in texts.split(rows.column("text"), texts.SPACES):
                    ids, _ = encoder.encode(words, separator)
                    out.write(ids.astype(dtype).tobytes())
                    names = rows.column("doc_id").slice(words.rows.start, len(words.counts))
                    yield _rows(path, np.arange(n, n + len(names)), names, None)
                    n, size = n + len(names), size + len(ids)
        yield _rows(path, np.array([-1]), pa.nulls(1, pa.int64()), size)

    schema = "file string, document bigint, doc_id bigint, n_tokens bigint"
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    written = materialise(text.mapInArrow(work, schema), "token-file-rows")
    return written.where("document < 0").select("file", "n_tokens"), written.where("document >= 0").select("file", "document", "doc_id")


def _rows(path: str, document: np.ndarray, names: pa.Array, size: int | None) -> pa.RecordBatch:
    n = len(document)
    arrays = [pa.array([path] * n, pa.string()), pa.array(document, pa.int64()), names, pa.array([size] * n, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["file", "document", "doc_id", "n_tokens"])


def _scan(separator: int, dtype: str, block: int):
    width = np.dtype(dtype).itemsize

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in source:
            for path, start in zip(rows.column("file").to_pylist(), rows.column("start").to_pylist(), strict=True):
                with files.open_input(path) as held:
                    held.seek(start * width)
                    ids = np.frombuffer(held.read(block * width), dtype)
                ends = start + np.flatnonzero(ids == separator)
                arrays = [pa.array([path], pa.string()), pa.array([start], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["file", "start", "ends"])

    return work


def token_counts(token_files: DataFrame, separator: int, dtype: str = "<u2", block: int = BLOCK_TOKENS) -> DataFrame:
    """``file, document, start, n_tokens, ended`` of every document in ``token_files(file, n_tokens)``.

    ``document`` numbers the documents of a file from 0, ``start`` is where its
    first token lies, ``n_tokens`` does not count the separator. Tokens after
    the last separator are a document with ``ended`` false; an empty file has
    none. A file listed twice counts once; a null name or size is no file.
    Other columns are ignored.
    """
    known = token_files.select("file", "n_tokens").dropna().where("n_tokens > 0").distinct()
    starts = known.select("file", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_tokens") - 1, F.lit(block).cast("bigint"))).alias("start"))
    spread = starts.repartition(F.col("file"), F.col("start"))
    blocks = materialise(spread.mapInArrow(_scan(separator, dtype, block), "file string, start bigint, ends array<bigint>"), "token-blocks")

    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    one = blocks.select("file", "start", F.size("ends").alias("_n"), F.array_max("ends").alias("_last"))  # a row per block
    carried = one.select(
        "file",
        "start",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_documents"),
        F.coalesce(F.max("_last").over(before) + 1, F.lit(0)).alias("_begin"),
    )
    whole = blocks.where(F.size("ends") > 0).join(carried, ["file", "start"])
    own = F.transform("ends", lambda e, i: F.struct(F.coalesce(F.get("ends", i - 1) + 1, F.col("_begin")).alias("b"), e.alias("e")))
    whole = whole.select("file", "_documents", F.posexplode(own).alias("_i", "_d")).select(
        "file",
        (F.col("_documents") + F.col("_i")).alias("document"),
        F.col("_d.b").alias("start"),
        (F.col("_d.e") - F.col("_d.b")).alias("n_tokens"),
        F.lit(True).alias("ended"),
    )
    last = one.groupBy("file").agg(F.sum("_n").alias("document"), F.coalesce(F.max("_last") + 1, F.lit(0)).alias("start"))
    open_ended = last.join(known, "file").where(F.col("start") < F.col("n_tokens"))
    open_ended = open_ended.select("file", "document", "start", (F.col("n_tokens") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.union(open_ended)
