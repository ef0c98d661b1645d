"""Queries of rules that read each key's events in order, over the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import slots
from .catalogue import query, t

LIMIT, MINUTES, AS_OF = 3, 2880, 1_708_000_000_000_000


@query("pool_slots", f"""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS pool, row_number() OVER w AS n, epoch_us(ts) AS us, CAST(CASE WHEN event_type = 'purchase' THEN lag(event_id) OVER w ELSE event_id END AS VARCHAR) AS job, CASE WHEN event_type = 'purchase' THEN 'done' ELSE 'submit' END AS event FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT DISTINCT pool, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(job VARCHAR, c BIGINT)[]) AS opened, CAST([] AS STRUCT(job VARCHAR, c BIGINT)[]) AS stale, CAST(NULL AS VARCHAR) AS outcome, CAST(0 AS BIGINT) AS running FROM e
UNION ALL SELECT pool, n, CASE outcome WHEN 'admitted' THEN list_append(live, struct_pack(job := job, c := us)) WHEN 'ended' THEN list_filter(live, lambda x: x.job <> job) ELSE live END, stale, outcome, len(live)
FROM (SELECT *, CASE WHEN event = 'submit' THEN CASE WHEN list_contains(list_transform(live, lambda x: x.job), job) THEN 'repeated' WHEN len(live) < {LIMIT} THEN 'admitted' ELSE 'rejected' END WHEN list_contains(list_transform(live, lambda x: x.job), job) THEN 'ended' ELSE 'ignored' END AS outcome
 FROM (SELECT e.pool, e.n, e.us, e.job, e.event, list_filter(s.opened, lambda x: x.c >= e.us - {MINUTES * 60_000_000}) AS live, list_filter(s.opened, lambda x: x.c < e.us - {MINUTES * 60_000_000}) AS stale FROM s JOIN e ON e.pool = s.pool AND e.n = s.n + 1))),
gone AS (SELECT pool, unnest(stale) AS x FROM s UNION ALL SELECT pool, unnest(list_filter(opened, lambda x: x.c < {AS_OF} - {MINUTES * 60_000_000})) FROM s QUALIFY row_number() OVER (PARTITION BY pool ORDER BY n DESC) = 1)
SELECT s.pool, e.job, e.us AS "at", e.event, s.outcome FROM s JOIN e USING (pool, n) UNION ALL SELECT pool, x.job, x.c + {MINUTES * 60_000_000}, 'timer', 'stale' FROM gone""")
def pool_slots(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ends = F.col("event_type") == "purchase"
    e = t(spark, sf, "events").select("user_id", "ts", "event_id", F.when(ends, F.lag("event_id").over(w)).otherwise(F.col("event_id")).alias("job"), F.when(ends, "done").otherwise("submit").alias("kind"))
    return slots.slots(e, "user_id", "job", "ts", "event_id", "kind", LIMIT, MINUTES, AS_OF).select("pool", "job", "at", "event", "outcome")


@query("upload_repeats", """WITH RECURSIVE k AS (SELECT user_id || '-' || event_type AS key, event_id, epoch_us(ts) AS us, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
r AS (SELECT key, n, event_id AS last, us AS last_at, CAST(NULL AS BIGINT) AS earlier FROM k WHERE n = 1
UNION ALL SELECT k.key, k.n, CASE WHEN k.us <= r.last_at + 86400000000 THEN r.last ELSE k.event_id END, CASE WHEN k.us <= r.last_at + 86400000000 THEN r.last_at ELSE k.us END, CASE WHEN k.us <= r.last_at + 86400000000 THEN r.last END FROM r JOIN k ON k.key = r.key AND k.n = r.n + 1)
SELECT key, CAST(event_id AS VARCHAR) AS id, us AS "at", CAST(earlier AS VARCHAR) AS earlier FROM r JOIN k USING (key, n)""")
def upload_repeats(spark, sf):
    e = t(spark, sf, "events").withColumn("key", F.concat_ws("-", "user_id", "event_type"))
    return slots.repeats(e, "key", "event_id", "ts", "event_id", 86400)
