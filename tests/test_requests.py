"""Resumable requests: keys per member, batches of pending members, upsert by stream."""

import pytest
from pyspark.sql import functions as F

from textprov.functions.text import parse_numbered
from textprov.operators import generate, requests
from textprov.sources.snapshots import SnapshotTable

HEADER = "Answer {n} items."


def members(spark, ids):
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "id long, text string")
    return df.withColumn("member_key", requests.member_key("t", F.col("id"), F.col("text")))


def formed(todo, size=4):
    return requests.form(todo, size, HEADER, F.format_string("[%d] %s", "ordinal", "text"))


def answerer():
    def answer(payload):        # nested, so that it goes to the workers by value
        return "\n".join(f"[{line[1:line.index(']')]}] re: {line[line.index(']') + 2:]}" for line in payload.split("\n\n")[1:])
    return answer


def keys(df):
    return {r.id: r.member_key for r in df.collect()}


def test_one_row_more_or_less_leaves_all_other_keys(spark):
    all_keys = keys(members(spark, range(30)))
    assert len(set(all_keys.values())) == 30
    assert keys(members(spark, range(31))).items() > all_keys.items()
    assert keys(members(spark, range(1, 30))).items() < all_keys.items()
    changed = members(spark, [3]).withColumn("text", F.lit("other"))
    assert changed.select(requests.member_key("t", F.col("id"), F.col("text"))).first()[0] != all_keys[3]


def test_only_pending_members_are_batched_and_sent(spark, tmp):
    table = SnapshotTable(spark, f"{tmp}/replies")
    first = members(spark, range(10))
    requests.store(table, requests.send(formed(first), answerer(), parse_numbered, generate.no_wait))
    before = {r.member_key: r.reply for r in requests.replies_of(table).collect()}
    assert before == {k: f"re: text {i}" for i, k in keys(first).items()}
    more = members(spark, range(8, 15))     # two gone from view, five new
    todo = requests.pending(more, requests.replies_of(table))
    assert sorted(keys(todo)) == [10, 11, 12, 13, 14]
    reqs = formed(todo).collect()
    assert sorted(r.n_items for r in reqs) == [1, 4] and {k for r in reqs for k in r.member_keys} == set(keys(todo).values())
    assert all(r.payload.startswith(f"Answer {r.n_items} items.\n\n[1] ") for r in reqs)


def test_failed_members_stay_pending_and_short_replies_are_padded(spark, tmp):
    table = SnapshotTable(spark, f"{tmp}/replies")
    m = members(spark, range(6))

    def broken(payload):
        raise generate.ServerFailure("503")
    requests.store(table, requests.send(formed(m, 6), broken, parse_numbered, generate.no_wait))
    assert requests.pending(m, requests.replies_of(table)).count() == 6
    requests.store(table, requests.send(formed(m, 6), lambda p: "[1] one\n[2] two", parse_numbered, generate.no_wait))
    stored = requests.replies_of(table)
    assert requests.pending(m, stored).isEmpty()
    for how, pad in (("fallback", lambda i: f"Write a text similar to: text {i}"), ("empty", lambda i: "")):
        got = {r.id: (r.reply, r.from_reply) for r in requests.filled(m, stored, how).collect()}
        assert len(got) == 6 and sum(f for _, f in got.values()) == 2
        assert all(r == pad(i) for i, (r, f) in got.items() if not f)
    assert requests.filled(m, stored, "drop").count() == 2


def test_surplus_items_are_dropped(spark):
    got = requests.send(formed(members(spark, [1]), 6), lambda p: "[1] a\n[2] b", parse_numbered).collect()
    assert [(r.reply, r.status) for r in got] == [("a", "ok")]


def test_waits_of_each_caller():
    slept = []
    for waits in (generate.MIRROR_WAITS, generate.STORY_WAITS):
        errors = iter([generate.RateLimited(), generate.ServerFailure()])

        def gen(payload):
            e = next(errors, None)
            if e:
                raise e
            return "x"
        assert generate.call_with_retry(gen, "p", sleep=slept.append, waits=waits)[1:3] == ("ok", 3)
    assert slept == [10, 12, 20, 20]


def test_stream_upsert_is_idempotent(spark, tmp):
    table = SnapshotTable(spark, f"{tmp}/table")
    ok = requests.send(formed(members(spark, range(5))), answerer(), parse_numbered, generate.no_wait)
    failed = ok.withColumns({"status": F.lit("failed"), "reply": F.lit(None).cast("string")})
    requests.write_reply_files(ok, f"{tmp}/in")

    def drain(name):
        requests.ingest(spark, f"{tmp}/in", table.root, f"{tmp}/cp-{name}", name).awaitTermination()
        return sorted((r.member_key, r.status, r.reply) for r in requests.replies_of(table).collect())
    got = drain("a")
    assert [s for _, s, _ in got] == ["ok"] * 5
    requests.write_reply_files(failed, f"{tmp}/in")       # a late failure replaces no answer
    assert drain("a") == got
    versions = table.versions()
    requests.store(table, failed, ("a", 0))             # the replay of a committed micro-batch
    assert table.versions() == versions
    assert drain("b") == got                            # another stream reads the files again, by another name


@pytest.mark.parametrize("n", [0, 1])
def test_no_or_one_member(spark, n):
    assert formed(members(spark, range(n)).where("true") if n else members(spark, [1]).limit(0)).count() == n


def test_resume_pending_runs_the_whole_first_run(spark, tmp):
    """False positives -> requests -> a run with a failing generator -> what is still to send, as the SQL has it."""
    import duckdb

    import __spark_entry__ as e
    n = 3000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of text"), F.sha1(F.col("id").cast("string"))).alias("text"),
                                 F.lit("s").alias("source"), F.lit("en").alias("lang"))
    docs.write.parquet(f"{tmp}/documents.parquet")
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")).write.parquet(f"{tmp}/labels.parquet")
    requests_of, status = ({r.request_id: r for r in e.queries()[q](spark, tmp).collect()} for q in ("request_payload", "gen_status"))
    got = {r.request_id: r.n_items for r in e.queries()["resume_pending"](spark, tmp).collect()}
    failed = {k for k, r in status.items() if r.status != "ok"}
    assert got == {k: requests_of[k].n_items for k in failed} and 0 < len(got) < len(status)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp}/{t}.parquet/*.parquet')")
    assert sorted(con.execute(e.oracle_sql()["resume_pending"]).fetchall()) == sorted(got.items())
