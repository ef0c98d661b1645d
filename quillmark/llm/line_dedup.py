"""Line dedup with per-document keep bitmaps.

Lines become 128-bit hashes of their keys (blanks stripped at both ends, A-Z lower-cased). The hashes are
range-partitioned by (hash, document), sorted by document and position, and streamed: a run of one hash is decided as
soon as enough documents are seen, so that no run is held whole. A run cut by a partition's edge is decided from small
edge summaries. What comes back is a compressed keep bitmap for each document that loses lines, not text.

A document is a row's (doc_id, text): rows that repeat both are one document and get the same bitmap. A null or empty
text is one empty line. A null id is an id of its own. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import dropped, written
from .textkit import slices

BLANKS = b" \t\n\x0b\x0c\r"
#: Longest byte run that may hide a key of too few code points; longer keys need no count.
_UTF8_MOST = 4

_LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32())])
_MARKS = pa.schema([("kind", pa.int8()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32()), ("part", pa.int32()), ("lead", pa.bool_()), ("n_docs", pa.int64())])
_MARKS_DDL = "kind tinyint, h1 long, h2 long, doc_id long, text_hash long, pos int, part int, lead boolean, n_docs long"
DROP, OPEN, EDGE = 0, 1, 2


def line_keys(text: str | None) -> list[bytes]:
    return [line.strip(BLANKS) for line in (text or "").encode().lower().split(b"\n")]


def _lines(batches: Iterator[pa.RecordBatch], least_chars: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        for part in slices(batch, "text"):
            joined, docs, pos, counts = [], [], [], []
            for text in part.column("text").to_pylist():
                keys = line_keys(text)
                at = [i for i, k in enumerate(keys) if len(k) >= least_chars and (len(k) >= _UTF8_MOST * least_chars or len(k.decode()) >= least_chars)]
                joined.extend(digest(keys[i]) for i in at)
                pos.extend(at)
                counts.append(len(at))
            if not pos:
                continue
            h = np.frombuffer(b"".join(joined), dtype=np.int64).reshape(-1, 2)
            docs = np.repeat(np.arange(part.num_rows), counts)
            take = lambda c: part.column(c).take(pa.array(docs))
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), take("doc_id"), take("text_hash"), pa.array(np.array(pos, np.int32))], schema=_LINES)


class _Run:
    """The rows of one hash within a partition: undecided ones are held, decided ones leave at once."""

    def __init__(self, key, part: int, least: int, keep_first: bool):
        self.key, self.part, self.least, self.keep_first = key, part, least, keep_first
        self.docs, self.last, self.held, self.first_row = 0, None, [], None

    def add(self, doc, pos, out: list) -> None:
        if doc != self.last:
            self.docs, self.last = self.docs + 1, doc
        row = (self.key, doc, pos)
        lead = self.first_row is None
        if lead:
            self.first_row = row
        if self.docs < self.least:
            self.held.append(row)
            return
        for r in self.held:
            if not (self.keep_first and r is self.first_row):
                out.append((DROP, *r[0], *r[1], r[2], self.part, False, 0))
        self.held = []
        if not (self.keep_first and lead):
            out.append((DROP, *row[0], *row[1], row[2], self.part, False, 0))

    def close(self, edge: bool, out: list) -> None:
        """At a partition's edge the rows that aren't decided, and the count, are told; elsewhere they stay."""
        if not edge:
            return
        out.append((EDGE, *self.key, None, None, None, self.part, False, self.docs))
        for r in self.held:
            out.append((OPEN, *r[0], *r[1], r[2], self.part, r is self.first_row, 0))
        if self.keep_first and self.docs >= self.least:
            r = self.first_row
            out.append((OPEN, *r[0], *r[1], r[2], self.part, True, 0))


def _streamed(batches: Iterator[pa.RecordBatch], least: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    run, first, part = None, True, 0
    as_batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _MARKS)], schema=_MARKS)
    for batch in batches:
        if not batch.num_rows:
            continue
        out: list = []
        h1, h2, doc, th, pos = (batch.column(c) for c in ("h1", "h2", "doc_id", "text_hash", "pos"))
        a, b = h1.to_numpy(), h2.to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, [len(a)]))
        part = batch.column("part")[0].as_py()
        sizes = np.diff(cuts)
        # a run inside the batch with too few rows to hold enough documents needs no look at its rows
        for k in np.flatnonzero((sizes >= least) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)):
            key = (int(a[cuts[k]]), int(b[cuts[k]]))
            if run is None or run.key != key:
                if run is not None:
                    run.close(first, out)
                    first = False
                run = _Run(key, part, least, keep_first)
            n = int(sizes[k])
            for d, t, p in zip(doc.slice(cuts[k], n).to_pylist(), th.slice(cuts[k], n).to_pylist(), pos.slice(cuts[k], n).to_pylist()):
                run.add((d, t), p, out)
        if out:
            yield as_batch(out)
    if run is not None:
        out = []
        run.close(True, out)
        if out:
            yield as_batch(out)


def bitmap(dropped_at: np.ndarray) -> bytes:
    """A keep bitmap, one bit a line up to the last dropped one, filled up with ones to whole bytes and deflated."""
    keep = np.ones((int(dropped_at.max()) // 8 + 1) * 8, dtype=bool)
    keep[dropped_at] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


@F.arrow_udf(T.BinaryType())
def packed(dropped_at: pa.Array) -> pa.Array:
    at, bounds = dropped_at.values.to_numpy(zero_copy_only=False), dropped_at.offsets.to_numpy()
    return pa.array([bitmap(at[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())


def unpacked(bitmap: bytes, n_lines: int) -> np.ndarray:
    """A flag for each line; lines past the bitmap's end are kept."""
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8)).astype(bool)[:n_lines]
    return np.concatenate((keep, np.ones(n_lines - len(keep), dtype=bool)))


def with_text_hash(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))


def keep_bitmaps(docs: DataFrame, least_docs: int = 2, least_chars: int = 1, keep_first: bool = True) -> DataFrame:
    """Bitmaps of the documents that lose lines: doc_id, text_hash, n_dropped, keep_bitmap; the others keep all.

    Keys of at least ``least_chars`` code points in at least ``least_docs`` documents lose all lines but, with
    ``keep_first``, the first by (document, position).
    """
    spark = docs.sparkSession
    source = with_text_hash(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    lines = written(source.mapInArrow(lambda it: _lines(it, least_chars), "h1 long, h2 long, doc_id long, text_hash long, pos int"), "lines")
    by = ["h1", "h2", "doc_id", "text_hash"]
    dealt = lines.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by, "pos").withColumn("part", F.spark_partition_id())
    marks = written(dealt.mapInArrow(lambda it: _streamed(it, least_docs, keep_first), _MARKS_DDL), "marks")
    edges = marks.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.sum("n_docs").alias("total"), F.min("part").alias("first_part")).where(F.col("total") >= least_docs)
    late = marks.where(F.col("kind") == OPEN).join(edges, ["h1", "h2"])
    if keep_first:
        late = late.where(~(F.col("lead") & (F.col("part") == F.col("first_part"))))
    gone = marks.where(F.col("kind") == DROP).select("doc_id", "text_hash", "pos").unionByName(late.select("doc_id", "text_hash", "pos"))
    found = gone.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("at"))
    out = written(found.select("doc_id", "text_hash", F.size("at").alias("n_dropped"), packed("at").alias("keep_bitmap")), "bitmaps")
    dropped(lines, marks)
    return out


@F.pandas_udf(T.StringType())
def _kept_text(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    def one(t, m):
        if m is None:
            return None
        lines = t.split("\n")
        return "\n".join(line for line, keep in zip(lines, unpacked(m, len(lines))) if keep)
    return pd.Series([one(t, m) for t, m in zip(text, bitmap)], dtype=object)


def without_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Every row of docs with kept_text, n_lines and n_dropped beside its own columns."""
    b = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("n_dropped").alias("_dropped"), F.col("keep_bitmap").alias("_keep"))
    text = F.coalesce(docs["text"], F.lit(""))
    d = docs.withColumn("_th", F.xxhash64(text))
    # bitmaps grow with the documents: one way of joining at every size
    j = d.join(b.hint("merge"), d["doc_id"].cast("bigint").eqNullSafe(b["_id"]) & (d["_th"] == b["_hash"]), "left")
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    return j.withColumns({"n_lines": n_lines, "n_dropped": F.coalesce("_dropped", F.lit(0)).cast("bigint"), "kept_text": F.coalesce(_kept_text(F.when(F.col("_keep").isNotNull(), text), F.col("_keep")), text)}).drop("_th", "_id", "_hash", "_dropped", "_keep")


def digest(kept: DataFrame) -> list[Column]:
    return [F.col("doc_id"), F.col("n_lines"), F.col("n_dropped"), F.sha2(F.col("kept_text"), 256).alias("kept_sha256")]


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = without_lines(docs, keep_bitmaps(docs, least_docs=10, least_chars=1, keep_first=False))
    return kept.select(*digest(kept))


OP5_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1)) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
bad AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bad.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE bad.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN bad ON k.key = bad.key GROUP BY doc_id
"""
