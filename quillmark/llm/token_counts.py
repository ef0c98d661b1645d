"""Token counts by separator scan.

A flat token file has no index: documents follow one another, each ended by the end-of-document id. Files are cut into
byte ranges of whole ids, a task reads its ranges and searches them for the separator with one vectorised comparison,
and tells the places of its separators; the tokens before a range's first separator belong to a document that an earlier
range began, so the carry of each range is stitched in by a prefix scan over one small row for each range. Files may be
of any size: no task reads one whole.

``packed`` makes such files from texts by a public byte-level vocabulary, whose path on the driver is a parameter; the
vocabulary itself, some hundred kilobytes, is shipped. A text that is null or empty has no tokens and still ends with a
separator. Rows are the unit; repeated or null ids are rows of their own. Special tokens' strings in a text are ordinary
text. Extra columns are ignored. An empty table gives an empty result.

Python opens the files through pyarrow (local and shared folders, HDFS, S3, GCS). Where it can't open a folder's scheme,
files are read whole by Spark's binary reader, up to 2 GB each, and ``packed`` keeps its blocks in a table.
"""

from __future__ import annotations

import base64
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import shared_dir, written
from .textkit import slices

VOCABULARY = os.environ.get("QUILLMARK_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The published split pattern of byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
#: Tokens of a block.
BLOCK = 1 << 18
#: Characters that are encoded at once; longer texts are cut before a space that follows a letter, which the pattern never joins.
PIECE = 1 << 16

_ENCODERS: dict = {}


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(ranks: bytes):
    """The encoder of a vocabulary's lines, made once a process."""
    import tiktoken

    if ranks not in _ENCODERS:
        pairs = map(bytes.split, ranks.splitlines())
        _ENCODERS[ranks] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return _ENCODERS[ranks]


_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


def encoded(text: str, ranks: bytes) -> list[int]:
    enc = encoder(ranks)
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    out: list[int] = []
    a = 0
    while a < len(text):
        m = _CUT.search(text, a + PIECE) if a + PIECE < len(text) else None
        b = m.start() if m else len(text)
        out += enc.encode_ordinary(text[a:b])
        a = b
    return out


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def can_open(uri: str) -> bool:
    """Whether Python itself can open files of this folder's scheme."""
    try:
        opened(uri)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


_NAMED = "stream string, block_no long, doc_ids array<long>"


def _packed(batches: Iterator[pa.RecordBatch], ranks, block: int, folder: str | None) -> Iterator[pa.RecordBatch]:
    """One flat stream a task, as a file or in blocks of ``block`` ids; of each block the ids of the documents that end in it."""
    name, number = uuid.uuid4().hex, 0
    stream = f"{folder}/{name}.bin" if folder else name
    buffer, ends = np.zeros(0, np.uint16), []
    sink = None

    def out(tokens, ids):
        nonlocal sink
        columns = [pa.array([stream]), pa.array([number]), pa.array([ids], pa.list_(pa.int64()))]
        if folder is None:
            return pa.RecordBatch.from_arrays([*columns, pa.array([tokens.tobytes()], pa.binary())], names=["stream", "block_no", "doc_ids", "tokens"])
        if sink is None:
            fs, path = opened(stream)
            fs.create_dir(os.path.dirname(path), recursive=True)
            sink = fs.open_output_stream(path)
        sink.write(tokens.tobytes())
        return pa.RecordBatch.from_arrays(columns, names=["stream", "block_no", "doc_ids"])

    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            ids = part.column("doc_id").to_pylist()
            rows = [np.array(encoded(t or "", ranks.value) + [END], dtype="<u2") for t in part.column("text").to_pylist()]
            stops = len(buffer) + np.cumsum([len(r) for r in rows])
            ends += list(zip(stops.tolist(), ids))
            buffer = np.concatenate([buffer, *rows])
            while len(buffer) >= block:
                yield out(buffer[:block], [d for s, d in ends if s <= block])
                ends = [(s - block, d) for s, d in ends if s > block]
                buffer, number = buffer[block:], number + 1
    if len(buffer):
        yield out(buffer, [d for _, d in ends])
    if sink is not None:
        sink.close()


def packed(docs: DataFrame, path: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """(stream, block_no, doc_ids): texts as flat files of 16-bit ids in the shared folder, and which documents end where.

    A lost task writes its file anew under another name; only files of finished tasks are named. Where Python can't open
    the shared folder, the table holds the blocks' tokens as well.
    """
    spark = docs.sparkSession
    shared = shared_dir(spark)
    folder = f"{shared}/quillmark-flat-{uuid.uuid4().hex}" if can_open(shared) else None
    ranks = spark.sparkContext.broadcast(vocabulary(path))
    mine = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return written(mine.mapInArrow(lambda it: _packed(it, ranks, block, folder), _NAMED if folder else f"{_NAMED}, tokens binary"), "tokens")


def token_files(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(stream, block_no): ranges of ``block`` ids of ``width`` bytes of all flat files; with tokens where Python can't open them."""
    def cut(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for k, a in enumerate(range(0, len(content), width * block)):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k]), pa.array([content[a : a + width * block]], pa.binary())], names=["stream", "block_no", "tokens"])

    files = spark.read.format("binaryFile").load(path)
    if not can_open(path if "://" in path else f"file://{path}"):
        return files.select("path", "content").mapInArrow(cut, "stream string, block_no long, tokens binary")
    ranges = F.sequence(F.lit(0), F.ceil(F.col("length") / (width * block)) - 1)
    return files.where("length > 0").select(F.col("path").alias("stream"), F.explode(ranges).alias("block_no")).repartition("stream", "block_no")


def _ranges(batch: pa.RecordBatch, width: int, block: int) -> Iterator[bytes]:
    if "tokens" in batch.schema.names:
        yield from batch.column("tokens").to_pylist()
        return
    name, file = None, None
    for stream, k in zip(batch.column("stream").to_pylist(), batch.column("block_no").to_pylist()):
        if stream != name:
            fs, path = opened(stream)
            name, file = stream, fs.open_input_file(path)
        file.seek(k * width * block)
        yield file.read(width * block)


def _scanned(batches: Iterator[pa.RecordBatch], end: int, width: int, block: int) -> Iterator[pa.RecordBatch]:
    kind = {2: np.dtype("<u2"), 4: np.dtype("<u4")}[width]
    for batch in batches:
        first, tail, counts = [], [], []
        for raw in _ranges(batch, width, block):
            ids = np.frombuffer(raw, dtype=kind)
            at = np.flatnonzero(ids == end)
            first.append(int(at[0]) if len(at) else None)
            tail.append(len(ids) - 1 - int(at[-1]) if len(at) else len(ids))
            counts.append(np.diff(at) - 1)
        yield pa.RecordBatch.from_arrays([batch.column("stream"), batch.column("block_no"), pa.array(first, pa.int64()), pa.array(tail, pa.int64()), pa.array([c.tolist() for c in counts], pa.list_(pa.int64()))], names=["stream", "block_no", "first", "tail", "inner"])


def scanned(blocks: DataFrame, end: int = END, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Of ranges (stream, block_no) of files, or of blocks with their tokens: (stream, block_no, lengths), the lengths of the documents that end in each block, also of those begun before it.

    A stream's last document may lack its separator; its open rest is told as ``open_tokens`` of the last block.
    """
    names = [c for c in ("stream", "block_no", "tokens") if c in blocks.columns]
    found = blocks.select(*names).mapInArrow(lambda it: _scanned(it, end, width, block), "stream string, block_no long, first long, tail long, inner array<long>")
    found = written(found, "scan")
    order = Window.partitionBy("stream").orderBy("block_no")
    # tokens since the last separator before this block: a running sum of tails that starts again at each separator
    marks = found.select("stream", "block_no", "first", "tail").withColumn("run", F.coalesce(F.sum(F.col("first").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)))
    carried = marks.withColumn("so_far", F.sum("tail").over(Window.partitionBy("stream", "run").orderBy("block_no")))
    carried = carried.withColumn("carry", F.coalesce(F.lag("so_far").over(order), F.lit(0))).withColumn("is_last", F.lead("block_no").over(order).isNull())
    return found.select("stream", "block_no", "inner").join(carried, ["stream", "block_no"]).select(
        "stream", "block_no",
        F.when(F.col("first").isNull(), F.array().cast("array<long>")).otherwise(F.concat(F.array(F.col("first") + F.col("carry")), "inner")).alias("lengths"),
        F.when(F.col("is_last"), F.col("so_far")).otherwise(F.lit(0)).alias("open_tokens"),
    )


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    streams = packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    lengths = scanned(streams)
    named = streams.select("stream", "block_no", "doc_ids").join(lengths, ["stream", "block_no"])
    each = named.select(F.explode(F.arrays_zip("doc_ids", "lengths")).alias("x"))
    return each.select(F.col("x.doc_ids").alias("doc_id"), F.col("x.lengths").alias("n_tokens"))
