"""Exact dedup by composable polynomial fingerprints.

A text's bytes are cut into chunks; each chunk has a polynomial hash modulo two primes, and the hash of a
concatenation is hash(a) * base^len(b) + hash(b), so the chunks of a huge text can be hashed apart. Rows of equal
fingerprint and length are then compared chunk by chunk, so that a collision never merges different texts.

Rows, not ids, are the unit: repeated ids are separate rows. A null text is an empty text; a null id sorts last among
the copies and keep_id is null only where every copy has a null id. Extra columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .textkit import slices

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
CHUNK = 1 << 16
#: Bytes of texts that a task remembers, to compare later copies before they are shuffled.
REMEMBERED = 32 << 20
#: Representatives of one fingerprint that are compared in one task before a further round is salted in.
FAN_IN = 4096

_POWERS: dict[int, np.ndarray] = {}
_BLANKS = re.compile(rb"[\x20\x09-\x0D]+")
_KEY = ["f1", "f2", "n_bytes"]
_MEMBER = "row_id string, doc_id bigint, f1 long, f2 long, n_bytes long, text_sha256 string, rep string, body binary"


def chunk_hash(data: bytes) -> tuple[tuple[int, int], int]:
    """Hash of one chunk of at most CHUNK bytes, and its length."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    out = []
    for p, base in zip(PRIMES, BASES):
        if p not in _POWERS:
            powers = [1]
            for _ in range(CHUNK - 1):
                powers.append(powers[-1] * base % p)
            _POWERS[p] = np.array(powers[::-1], dtype=np.uint64)
        out.append(int((b * _POWERS[p][CHUNK - len(b) :]).sum(dtype=np.uint64) % np.uint64(p)))
    return (out[0], out[1]), len(data)


def combined(a: tuple[tuple[int, int], int], b: tuple[tuple[int, int], int]) -> tuple[tuple[int, int], int]:
    """Hash and length of the concatenation: a is shifted by b's length."""
    return tuple((x * pow(base, b[1], p) + y) % p for x, y, p, base in zip(a[0], b[0], PRIMES, BASES)), a[1] + b[1]


def fingerprint(data: bytes) -> tuple[int, int, int]:
    total = ((0, 0), 0)
    for k in range(0, len(data), CHUNK):
        total = combined(total, chunk_hash(data[k : k + CHUNK]))
    return (*total[0], total[1])


def same(a: bytes, b: bytes) -> bool:
    """Chunkwise comparison; stops at the first chunk that differs."""
    x, y = memoryview(a), memoryview(b)
    return len(x) == len(y) and all(x[k : k + CHUNK] == y[k : k + CHUNK] for k in range(0, len(x), CHUNK))


def normal_form(text: str | None) -> bytes:
    """Each run of blanks becomes one space."""
    return _BLANKS.sub(b" ", (text or "").encode())


def _hashed(batches: Iterator[pa.RecordBatch], print_of: Callable) -> Iterator[pa.RecordBatch]:
    """A row for each document; the body goes only with the first of the equal texts this task remembers."""
    known: dict[tuple, list[tuple[str, bytes]]] = {}
    held, task, n = 0, uuid.uuid4().hex, 0
    schema = pa.schema([("row_id", pa.string()), ("doc_id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("n_bytes", pa.int64()), ("text_sha256", pa.string()), ("rep", pa.string()), ("body", pa.binary())])
    for batch in batches:
        for part in slices(batch, "text"):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                body = normal_form(text)
                key = print_of(body)
                row, n = f"{task}-{n}", n + 1
                rep = next((r for r, other in known.get(key, ()) if same(other, body)), None)
                rows.append((row, doc_id, *key, hashlib.sha256(body).hexdigest(), rep or row, None if rep else body))
                if rep is None:
                    if held + len(body) > REMEMBERED:
                        known.clear()
                        held = 0
                    if len(body) <= REMEMBERED:
                        known.setdefault(key, []).append((row, body))
                        held += len(body)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by fingerprint: each body is compared with the different bodies of its fingerprint so far."""
    at, kinds = None, []
    for batch in batches:
        rows = []
        for *key, row, body in zip(*(batch.column(c).to_pylist() for c in (*_GROUP, "rep", "body"))):
            if key != at:
                at, kinds = key, []
            head = next((r for r, other in kinds if same(other, body)), None)
            if head is None:
                kinds.append((row, body))
            rows.append((row, head or row))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["rep", "head"])


_GROUP = [*_KEY, "salt"]


def exact_classes(docs: DataFrame, print_of: Callable = fingerprint, fan_in: int = FAN_IN) -> DataFrame:
    """Every row of (doc_id, text) with the class of its text: doc_id, keep_id, group_size, kept, text_sha256.

    ``print_of`` maps bytes to (f1, f2, length); tests pass one that collides. Texts are shuffled once, without the
    copies that a task has seen; only if more than ``fan_in`` representatives share a fingerprint are they compared in
    salted parts first, round by round.
    """
    members = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).mapInArrow(lambda it: _hashed(it, print_of), _MEMBER), "prints")
    bodies = members.where("body IS NOT NULL")
    chain = []
    while True:
        most = bodies.groupBy(*_KEY).count().agg(F.max("count")).first()[0] or 0
        parts = -(-most // fan_in)
        left = bodies.select(*_KEY, "rep", "body", (F.pmod(F.xxhash64("rep"), F.lit(parts)) if parts > 1 else F.lit(0)).cast("long").alias("salt"))
        heads = written(left.repartition(*[F.col(c) for c in _GROUP]).sortWithinPartitions(*_GROUP, "rep").mapInArrow(_compared, "rep string, head string"), "heads")
        chain.append(heads)
        if parts <= 1:
            break
        left = bodies.join(heads.where("rep = head").select("rep"), "rep", "left_semi")
        if left.groupBy(*_KEY).count().agg(F.max("count")).first()[0] >= most:  # all differ: no part can shrink
            chain.append(written(left.repartition(*[F.col(c) for c in _KEY]).withColumn("salt", F.lit(0).cast("long")).sortWithinPartitions(*_GROUP, "rep").mapInArrow(_compared, "rep string, head string"), "heads"))
            break
        bodies = left
    to = chain[0]
    for heads in chain[1:]:
        to = to.alias("a").join(heads.alias("b"), F.col("a.head") == F.col("b.rep"), "left").select("a.rep", F.coalesce("b.head", "a.head").alias("head"))
    # a representative stands for rows of one task, a class has one for each task at most: no join has a hot key
    per_rep = members.groupBy("rep").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row_id")).alias("least"), F.count("*").alias("n")).join(to, "rep")
    classes = per_rep.groupBy("head").agg(F.min("least").alias("first"), F.sum("n").alias("group_size"))
    named = per_rep.select("rep", "head").join(classes, "head").select("rep", "first", "group_size")
    rows = members.select("row_id", "doc_id", "text_sha256", "rep").join(named, "rep")
    return rows.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("first.row_id")).alias("kept"), "text_sha256")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
