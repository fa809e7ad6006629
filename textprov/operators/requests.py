"""Resumable generation requests, keyed by member.

Every member of a request (a text to be answered) has a key made of its own content:
kind of request, template version, id and hash of the input.  Replies are stored by
member key, in a versioned table, by an idempotent upsert; what is still to be sent
are the members without a final reply, and batches are formed of these alone.  So a row
more or less, another batch size or a restart changes nobody else's key, and no
answered member is sent again.

  members -> pending (anti join) -> form (global numbers, batches) -> send -> store (upsert)
                                                 reply files -> ingest (stream, upsert) --^
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.snapshots import SnapshotTable, upsert
from .batches import assign_batches
from .generate import (FALLBACK_CHARS, FALLBACK_PROMPT, MIRROR_WAITS, TEMPLATE_VERSION, Waits, call_with_retry)

#: ok: answered; short: the reply had no item for this member (padded on use); failed: to be sent again.
FINAL = ("ok", "short")

MEMBER_REPLY_SCHEMA = T.StructType([
    T.StructField("member_key", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("reply", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
    T.StructField("error", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])


def member_key(kind: str, member_id: Column, content: Column, version: str = TEMPLATE_VERSION) -> Column:
    return F.md5(F.concat(F.lit(f"{kind}:{version}:"), member_id.cast("string"), F.lit(":"), F.md5(content)))


def pending(members: DataFrame, stored: DataFrame) -> DataFrame:
    """Members (with ``member_key``) that have no final reply among the stored ones."""
    done = stored.where(F.col("status").isin(*FINAL)).select("member_key")
    return members.join(done, "member_key", "left_anti")


def form(todo: DataFrame, size: int, header: str, item: Column, seed="requests") -> DataFrame:
    """Requests of ``size`` members each: batch_id, n_items, request_id, member_keys, payload.

    ``item`` is the member's part of the payload and may use ``ordinal``; ``header`` may hold ``{n}``.  Groups
    hold ``size`` rows at most.  ``request_id`` names a call; nothing is keyed by it.
    """
    b = assign_batches(todo, size, seed=seed, id_col="member_key").select("batch_id", "ordinal", "member_key", item.alias("item"))
    g = b.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "member_key", "item"))).alias("items"))
    keys = F.transform("items", lambda s: s["member_key"])
    n = F.size("items")
    return g.select("batch_id", n.alias("n_items"), F.md5(F.array_join(keys, ",")).alias("request_id"), keys.alias("member_keys"),
                    F.concat(F.format_string(header.replace("{n}", "%1$d"), n), F.lit("\n\n"),
                             F.array_join(F.transform("items", lambda s: s["item"]), "\n\n")).alias("payload"))


def send(requests: DataFrame, gen: Callable[[str], str], parse: Callable[[Column], Column],
         sleep: Callable[[float], None] = time.sleep, waits: Waits = MIRROR_WAITS) -> DataFrame:
    """Call the generator once per request; one row per member.  ``parse`` makes a reply an array of items, item k
    answers member k; items beyond the members are dropped, members beyond the items are ``short``."""
    def call(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = [call_with_retry(gen, p, sleep=sleep, waits=waits) for p in pdf["payload"]]
            yield pd.DataFrame({"request_id": pdf["request_id"].values, "member_keys": pdf["member_keys"].values,
                                "reply": [o[0] for o in out], "status": [o[1] for o in out],
                                "attempts": pd.array([o[2] for o in out], dtype="int32"), "error": [o[3] for o in out]})
    answered = requests.select("request_id", "member_keys", "payload").mapInPandas(
        call, "request_id string, member_keys array<string>, reply string, status string, attempts int, error string")
    rows = answered.withColumn("items", parse(F.col("reply"))).select(
        "request_id", "status", "attempts", "error", "items", F.posexplode("member_keys").alias("pos", "member_key"))
    mine = F.try_element_at("items", F.col("pos") + 1)
    return rows.select("member_key", "request_id", mine.alias("reply"),
                       F.when(F.col("status") != "ok", F.col("status")).when(mine.isNull(), "short").otherwise("ok").alias("status"),
                       "attempts", "error", F.current_timestamp().alias("ts"))


def better() -> list[Column]:
    """Of two replies of a member: an answer over a short reply over a failure, then the later one."""
    rank = F.when(F.col("status") == "ok", 2).when(F.col("status") == "short", 1).otherwise(0)
    return [rank.alias("rank"), F.col("ts"), F.col("attempts"), F.col("reply")]


def store(table: SnapshotTable, replies: DataFrame, txn: tuple[str, int] | None = None) -> int:
    columns = [f.name for f in MEMBER_REPLY_SCHEMA.fields]
    return upsert(table, replies.select(*columns), "member_key", better(), txn)


def replies_of(table: SnapshotTable) -> DataFrame:
    return table.read(schema=MEMBER_REPLY_SCHEMA)


def filled(members: DataFrame, stored: DataFrame, short: str = "fallback", content: str = "text") -> DataFrame:
    """Members with ``reply``; one without an item gets a fallback made of its content (``fallback``), an empty
    text (``empty``), or goes (``drop``).  Members that failed or were never sent count as short."""
    x = members.join(stored.where(F.col("status") == "ok").select("member_key", "reply"), "member_key", "left")
    if short == "drop":
        return x.where(F.col("reply").isNotNull())
    pad = {"fallback": F.concat(F.lit(FALLBACK_PROMPT), F.substring(content, 1, FALLBACK_CHARS)), "empty": F.lit("")}[short]
    return x.withColumn("from_reply", F.col("reply").isNotNull()).withColumn("reply", F.coalesce("reply", pad))


def write_reply_files(replies: DataFrame, folder: str) -> None:
    """Member replies as JSON-line files, as a worker outside the job would drop them."""
    replies.select(*[f.name for f in MEMBER_REPLY_SCHEMA.fields]).write.mode("append").json(folder)


def ingest(spark: SparkSession, folder: str, root: str, checkpoint: str, name: str = "replies", max_files: int = 1000) -> StreamingQuery:
    """Stream dropped reply files into the versioned table at ``root``.

    Every micro-batch is one upsert whose transaction is (name, batch number): a batch that is replayed after a
    failure has been committed or has not, and counts once either way.
    """
    def merge(batch: DataFrame, number: int) -> None:
        store(SnapshotTable(batch.sparkSession, root), batch, (name, number))

    return (spark.readStream.schema(MEMBER_REPLY_SCHEMA).option("maxFilesPerTrigger", max_files).json(folder)
            .writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
