"""Quotation linking: reply-ordered conversations without quotes.

Lines that start with quote marks ('>', also spaced or repeated) are quoted at that depth; the line that introduces a
quote ("... wrote:") belongs to it. Runs of lines of one depth are passages. A passage is normalised (quote marks gone,
runs of blanks and line ends as one space, A-Z lower-cased) and hashed, so that passages which a mail program wrapped
anew still meet; so are its paragraphs, sentences and lines, for quotes of a part. These hashes are joined to those of
the own text of earlier messages of the same conversation: its whole, its paragraphs, sentences and lines, where the
latest message before the quoting one that says it counts. Every match votes with its number of words; the message with
most votes among the shallowest quotes that match, the latest of equals, is the one replied to. A message without such a
link replies to the message before it.

The reply tree of a conversation is read root first, each message's replies in turn order, each with all replies to it;
a message's position counts from 0 in that order. A thread is the first message that quotes lead to. Rows are the unit:
of equal turns the order is by role and text. Null turns come first, null conversations are one conversation, null texts
are empty. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked, running
from .scratch import dropped, written
from .textkit import slices

QUOTE = re.compile(r"^((?:[ \t]*>)+)[ \t]?(.*)$", re.S)
#: Lines that introduce a quote, in the languages of the corpus.
INTRO = re.compile(r"(?i)^(?:on|le|am|el)\b.{4,200}(?:wrote|écrit|schrieb|escribió)\s*:\s*$|^-{2,}\s*(?:original message|message d'origine|ursprüngliche nachricht|mensaje original)\s*-{2,}\s*$")
_BLANKS = re.compile(r"[\x20\x09-\x0D]+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
#: Rows of a conversation among which the latest sayer of a passage is searched at once.
ROWS = 4096
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def levels(text: str | None) -> list[tuple[int, str]]:
    """(quote depth, bare line) for each line."""
    out = []
    for line in (text or "").split("\n"):
        m = QUOTE.match(line)
        out.append((m[1].count(">"), m[2]) if m else (0, line))
    return out


def normal_line(line: str) -> str:
    return _BLANKS.sub(" ", line).strip(" ").translate(_LOWER)


def passage_hash(text: str) -> int:
    """Signed 64-bit hash of a normalised passage."""
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def units(lines: list[str]) -> dict[str, int]:
    """The normalised passage, its paragraphs, sentences and lines, each with its number of words."""
    plain = list(map(normal_line, lines))
    paragraphs = [" ".join(g) for has, g in groupby(plain, key=bool) if has]
    sentences = [x for p in paragraphs for x in _SENTENCE.split(p)]
    return {x: x.count(" ") + 1 for x in [" ".join(paragraphs), *paragraphs, *sentences, *plain] if x}


def parsed(text: str | None) -> tuple[str, list[int], list[tuple[int, int, int]], int]:
    """(text without quotes, hashes of own units, (depth, hash, words) of quoted ones, number of quoted passages)."""
    lines = levels(text)
    own, said, quoted, passages = [], [], [], 0
    for k, (depth, line) in enumerate(lines):
        if depth:
            if k == 0 or lines[k - 1][0] != depth:
                quoted.append((depth, []))
                said.append("")
            quoted[-1][1].append(line)
        elif not (INTRO.match(line.strip()) and any(d for d, _ in lines[k + 1 : k + 3])):
            own.append(line)
            said.append(line)
    passages = len(quoted)
    if quoted:
        while own and not own[0].strip():
            own.pop(0)
        while own and not own[-1].strip():
            own.pop()
    return "\n".join(own), list(map(passage_hash, units(said))), [(d, passage_hash(x), n) for d, q in quoted for x, n in units(q).items()], passages


_PARSED = "row_no long, nil boolean, conv long, turn long, role string, body string, own array<long>, quoted array<struct<depth:int,hash:long,words:int>>, n_quotes int"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    q = pa.list_(pa.struct([("depth", pa.int32()), ("hash", pa.int64()), ("words", pa.int32())]))
    for batch in batches:
        for part in slices(batch, "text"):
            rows = [parsed(t) for t in part.column("text").to_pylist()]
            bodies, own, quoted, n = zip(*rows)
            quoted = pa.array([[{"depth": d, "hash": h, "words": n} for d, h, n in x] for x in quoted], q)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row_no", "nil", "conv", "turn", "role")), pa.array(bodies, pa.string()), pa.array(own, pa.list_(pa.int64())), quoted, pa.array(n, pa.int32())], names=["row_no", "nil", "conv", "turn", "role", "body", "own", "quoted", "n_quotes"])


def replied_to(own: DataFrame, quoted: DataFrame, unit: list[str]) -> DataFrame:
    """(row, parent) of the messages whose quotes match, from the rows that say a unit and those that quote it.

    The latest sayer before a quoting row is the last one of its stretch of ROWS rows or else of the stretches before, so
    no task orders all rows of a unit that everybody says.
    """
    stretch = F.floor(F.col("row") / ROWS).alias("stretch")
    said_by = own.select(*unit, stretch, "row", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("int").alias("words"), F.col("row").alias("by"))
    events = said_by.unionByName(quoted.select(*unit, stretch, "row", "depth", "words", F.lit(None).cast("long").alias("by")))
    last = events.groupBy(*unit, "stretch").agg(F.max("by").alias("by")).withColumn("earlier", F.max("by").over(Window.partitionBy(*unit).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)))
    before = Window.partitionBy(*unit, "stretch").orderBy("row").rangeBetween(Window.unboundedPreceding, -1)
    votes = events.withColumn("here", F.max("by").over(before)).where("depth IS NOT NULL").join(last.select(*unit, "stretch", "earlier"), [*unit, "stretch"])
    votes = votes.select("row", "depth", "words", F.coalesce("here", "earlier").alias("to_row")).where("to_row IS NOT NULL")
    counted = votes.groupBy("row", "to_row", "depth").agg(F.sum("words").alias("n"))
    return counted.groupBy("row").agg(F.min_by("to_row", F.struct("depth", -F.col("n"), -F.col("to_row"))).alias("parent"))


def places(full: DataFrame, start: DataFrame, by: list[str]) -> DataFrame:
    """(row_no, position): the order in which the reply trees are read.

    Rows that reply to the row before them follow it at once, so only runs of such rows are ordered: the runs that reply
    into one run come after it, those to its later rows first. Runs form a list; its places come by doubling steps.
    """
    runs_at = (F.col("parent").isNotNull() & (F.col("parent") < F.col("row_no") - 1)) | (F.col("row_no") == F.col("first_row"))
    rows = full.select("row_no", *by, "parent").join(start, by).withColumn("is_head", runs_at)
    numbered = written(running(rows, [F.col("row_no")], F.col("is_head"), "run").select("row_no", "parent", "is_head", "run", "first_row"), "runs")
    runs = numbered.groupBy("run").agg(F.min("row_no").alias("head"), F.count("*").alias("n"), F.min("first_row").alias("first_row"))
    hung = numbered.where("is_head AND row_no > first_row").select("run", F.col("row_no").alias("head"), F.col("parent").alias("to_row"))
    hung = hung.join(numbered.select(F.col("row_no").alias("to_row"), F.col("run").alias("up")), "to_row")
    order = written(ranked(hung, [F.col("up"), F.desc("to_row"), F.col("head")], "nth").select("run", "up", "nth"), "order")
    nxt = order.select(F.col("run").alias("next"), F.col("up").alias("next_up"), (F.col("nth") - 1).alias("nth"))
    beside = order.join(nxt, "nth", "left").select("run", "up", F.when(F.col("up") == F.col("next_up"), F.col("next")).alias("next"))
    # where to go on after a run and all that hangs on it: its next sibling, or that of the nearest run above that has one
    out, moving = written(beside.select("run", F.col("next").alias("exit"), F.when(F.col("next").isNull(), F.col("up")).alias("jump")), "exits"), True
    while moving:
        above = out.select(F.col("run").alias("jump"), F.col("exit").alias("exit_up"), F.col("jump").alias("jump_up"))
        new = written(out.join(above, "jump", "left").select("run", F.coalesce("exit", "exit_up").alias("exit"), F.when(F.col("exit").isNull(), F.col("jump_up")).alias("jump")), "exits")
        dropped(out)
        out, moving = new, bool(new.where("jump IS NOT NULL").limit(1).count())
    child = order.groupBy("up").agg(F.min_by("run", "nth").alias("child")).withColumnRenamed("up", "run")
    listed = order.select("run").unionByName(order.select(F.col("up").alias("run"))).distinct().join(runs.select("run", "n"), "run").join(child, "run", "left").join(out, "run", "left")
    left, moving = written(listed.select("run", "n", F.coalesce("child", "exit").alias("next")), "left"), True
    while moving:
        then = left.select(F.col("run").alias("next"), F.col("n").alias("n_next"), F.col("next").alias("after"))
        new = written(left.join(then, "next", "left").select("run", (F.col("n") + F.coalesce("n_next", F.lit(0))).alias("n"), F.col("after").alias("next")), "left")
        dropped(left)
        left, moving = new, bool(new.where("next IS NOT NULL").limit(1).count())
    tail = left.select("run", F.col("n").alias("tail"))
    whole = runs.where("head = first_row").join(tail, "run").select("first_row", F.col("tail").alias("whole"))
    at = runs.join(tail, "run", "left").join(whole, "first_row", "left").select("run", "head", F.coalesce(F.col("whole") - F.col("tail"), F.lit(0)).alias("at"))
    return numbered.select("row_no", "run").join(at, "run").select("row_no", (F.col("at") + F.col("row_no") - F.col("head")).cast("bigint").alias("position"))


def linked(conversations: DataFrame) -> DataFrame:
    """Every row: conv_id, turn, role, position, reply_to (a position's turn), thread, n_quotes, text without quotes."""
    rows = conversations.select(F.col("conv_id").isNull().alias("nil"), F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("conv"), F.col("turn").cast("bigint").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    by = ["nil", "conv"]
    numbered = ranked(rows, [F.col(c) for c in (*by, "turn", "role", "text")], "row_no")
    said = written(numbered.select(F.col("row_no").cast("bigint").alias("row_no"), *by, "turn", "role", "text").mapInArrow(_parsed, _PARSED), "said")
    # only units that some message of the same conversation quotes are looked up: one row for each of them and its sayers' least and latest need no pairs
    quoted = said.where(F.size("quoted") > 0).select(*by, F.col("row_no").alias("row"), F.explode("quoted").alias("q")).select(*by, "q.hash", "row", "q.depth", "q.words")
    own = said.select(*by, F.col("row_no").alias("row"), F.explode(F.array_distinct("own")).alias("hash")).join(quoted.select(*by, "hash").distinct(), [*by, "hash"], "left_semi")
    parent = written(replied_to(own, quoted, [*by, "hash"]), "parents")
    # the first message that quotes lead to, by doubling steps
    root = written(parent.select("row", F.col("parent").alias("top")), "tops")
    while True:
        nxt = root.alias("a").join(root.alias("b"), F.col("a.top") == F.col("b.row"), "left").select("a.row", F.coalesce("b.top", "a.top").alias("top"), F.col("b.top").isNotNull().alias("moved"))
        new = written(nxt, "tops")
        dropped(root)
        if not new.where("moved").limit(1).count():
            break
        root = new.select("row", "top")
        root._quillmark_path = new._quillmark_path
    full = said.join(parent, said["row_no"] == parent["row"], "left").drop("row").join(new.select(F.col("row").alias("_row"), "top"), F.col("row_no") == F.col("_row"), "left")
    full = written(full.select("row_no", *by, "turn", "role", "body", "n_quotes", "parent", F.coalesce("top", "row_no").alias("top")), "linked")
    start = full.groupBy(*by).agg(F.min("row_no").alias("first_row"))
    # one row for each conversation meets its messages; a hot conversation's messages are split by Spark
    out = full.join(start, by).join(places(full, start, by), "row_no")
    reply = F.when(F.col("parent").isNotNull(), F.col("parent")).when(F.col("row_no") > F.col("first_row"), F.col("row_no") - 1)
    return out.select(F.when(~F.col("nil"), F.col("conv")).alias("conv_id"), "turn", "role", "position", (reply - F.col("first_row")).cast("bigint").alias("reply_to"), (F.col("top") - F.col("first_row")).cast("bigint").alias("thread"), F.col("parent").isNotNull().alias("by_quote"), "n_quotes", F.col("body").alias("text"))


def op2_quotation(spark, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
