"""Queries: request batches and payloads, reply parsing, padding, retries, resume,
mirror rows and creative rows, with deterministic offline generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tables
from ..functions import text as tx
from ..functions.hashing import hash32, stable_id
from ..operators import batches, filters, generate, requests, sample
from .catalog import SCORES_CTE, batch_sql, h32, query, stable_id_sql, strip_sql, ws_tokens_sql
from ..session import scratch_path
from ..sources.snapshots import SnapshotTable
from .q_metrics import scored

# Creative prompt grid (styles, lengths in words, topics)
STYLES = ["literary fiction", "thriller", "mystery", "sci-fi", "fantasy",
          "magical realism", "slice-of-life", "horror", "romance", "historical"]
LENGTHS = ["200", "300", "400", "500", "600"]
TOPICS = [
    "a detective solving their last case", "first contact with aliens",
    "a letter never sent", "the last day of summer", "a stranger on a train",
    "waking up in someone else's body", "a secret room in an old house",
    "the day the music stopped", "a conversation between ghosts",
    "finding a message in a bottle", "a heist gone wrong",
    "a chef's worst night", "parallel universes colliding",
    "an astronaut's diary entry", "a forbidden library",
    "a deal with the devil", "the view from a lighthouse",
    "an unreliable narrator at a dinner party", "time travel gone wrong",
    "a love story told backwards", "the last bookshop in the city",
    "a storm at sea", "a lost civilization",
    "a musician's final performance", "a garden that grows memories",
    "a map to nowhere", "a rival's redemption",
    "a king disguised as a beggar", "the inheritance nobody wanted",
    "a photograph that changes everything", "the last train home",
    "an impossible choice", "a world without color",
    "the neighbor's secret", "a forgotten promise",
    "the space between heartbeats", "a city that never sleeps",
    "the wrong door", "a voice from the past",
    "the price of immortality", "a bridge between worlds",
]
STORY_PROMPT = "Write a %s short story of about %s words about %s. Use vivid details and varied sentences."
NL = "chr(10)"


def _sql_list(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


# false positives with text, batched by 10 (the same rule as operators.batches)
FP_BATCH_CTE = SCORES_CTE + f""",
fp AS (SELECT example_id, text FROM scored WHERE label = 0 AND pred = 1 AND text IS NOT NULL AND text <> ''),
fpb AS (SELECT example_id, text, {batch_sql(10)} FROM fp)"""

_H1, _H2 = generate.PROMPT_HEADER.split("{n}")[0], generate.PROMPT_HEADER.split("{n}")[1]
_H3 = generate.PROMPT_HEADER.split("{n}")[2]


def _q(s):
    return "'" + s.replace("'", "''") + "'"


PAYLOAD_CTE = FP_BATCH_CTE + f""",
req AS (SELECT batch_id, CAST(count(*) AS INTEGER) AS n_items,
               md5('1:' || string_agg(CAST(example_id AS VARCHAR), ',' ORDER BY ordinal) || ':{generate.TEMPLATE_VERSION}') AS request_id,
               {_q(_H1)} || count(*) || {_q(_H2)} || count(*) || {_q(_H3)} || {NL} || {NL} ||
               string_agg('[' || ordinal || ']' || {NL} || '\"\"\"' || substr(text, 1, 1000) || '\"\"\"', {NL} || {NL} ORDER BY ordinal) AS payload,
               count(*) FILTER (WHERE len({ws_tokens_sql('substr(text, 1, 1000)')}) % 4 <> 0) AS n_present
        FROM fpb GROUP BY batch_id),
st AS (SELECT *, substr(md5(payload), 1, 1) AS h FROM req),
status AS (SELECT batch_id, request_id, n_items,
  CASE WHEN h = '4' OR h = 'f' OR n_present = 0 THEN 'failed' ELSE 'ok' END AS status,
  CAST(CASE WHEN h = 'f' THEN 1 WHEN h = '4' OR n_present = 0 THEN 3 WHEN h IN ('0', '1', '2', '3') THEN 2 ELSE 1 END AS INTEGER) AS attempts,
  CASE WHEN h = 'f' THEN 'auth' WHEN h = '4' THEN 'server' WHEN n_present = 0 THEN 'empty' END AS error
  FROM st)"""


def fp_rows(spark, d):
    return filters.has_text(filters.false_positives(scored(spark, d))).select("example_id", "text")


def prompt_stage(spark, d):
    members, req = generate.prompt_requests(fp_rows(spark, d), round_no=1)
    return members, req


@query("request_payload", f"WITH {PAYLOAD_CTE}\nSELECT batch_id, n_items, request_id, payload FROM req")
def q_request_payload(spark, d):
    _, req = prompt_stage(spark, d)
    return req.select("batch_id", "n_items", "request_id", "payload")


@query("gen_status", f"WITH {PAYLOAD_CTE}\nSELECT request_id, status, attempts, error FROM status")
def q_gen_status(spark, d):
    _, req = prompt_stage(spark, d)
    rep = generate.run_requests(req, generate.FlakyGenerator(generate.StubPromptWriter()),
                                sleep=generate.no_wait)
    return rep.select("request_id", "status", "attempts", "error")


@query("resume_pending", f"""
WITH {PAYLOAD_CTE}
SELECT request_id, n_items FROM status WHERE status <> 'ok'""")
def q_resume_pending(spark, d):
    """A first run with a failing generator, then the requests still to send."""
    _, req = prompt_stage(spark, d)
    done = generate.run_requests(req, generate.FlakyGenerator(generate.StubPromptWriter()),
                                 sleep=generate.no_wait)
    return generate.pending_requests(req, done).select("request_id", "n_items")


# --- requests keyed by member: user turns are the members, the assistant turn right after one is its reply --------

TURN_HEADER = "Answer each of the following {n} messages."

MEMBERS_CTE = """u AS (SELECT conv_id, turn, text, md5('turn:v1:' || conv_id || ':' || turn || ':' || md5(text)) AS member_key
      FROM conversations WHERE role = 'user' AND text IS NOT NULL AND turn IS NOT NULL),
a AS (SELECT conv_id, turn - 1 AS turn, text AS reply FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
pend AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.conv_id = u.conv_id AND a.turn = u.turn))"""


def turn_members(spark, d):
    """One member per user turn: conv_id, turn, text, member_key."""
    c = tables.read(spark, d, "conversations").where((F.col("role") == "user") & F.col("text").isNotNull() & F.col("turn").isNotNull())
    name = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    return c.select("conv_id", "turn", "text", requests.member_key("turn", name, F.col("text")).alias("member_key"))


def turn_replies(spark, d):
    """The recorded reply of every user turn that has one."""
    c = tables.read(spark, d, "conversations").where((F.col("role") == "assistant") & F.col("text").isNotNull())
    a = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return turn_members(spark, d).join(a, ["conv_id", "turn"]).select(
        "member_key", F.lit(None).cast("string").alias("request_id"), "reply", F.lit("ok").alias("status"),
        F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("error"), F.timestamp_seconds(F.lit(1)).alias("ts"))


@query("member_keys", f"WITH {MEMBERS_CTE}\nSELECT conv_id, turn, member_key FROM u")
def q_member_keys(spark, d):
    """Request keys made of each member's own content."""
    return turn_members(spark, d).select("conv_id", "turn", "member_key")


@query("pending_members", f"WITH {MEMBERS_CTE}\nSELECT conv_id, turn, member_key FROM pend")
def q_pending_members(spark, d):
    """User turns without a recorded reply: what a restarted job still has to send."""
    return requests.pending(turn_members(spark, d), turn_replies(spark, d)).select("conv_id", "turn", "member_key")


@query("pending_requests", f"""
WITH {MEMBERS_CTE},
b AS (SELECT *, {batch_sql(10, 'member_key', 'requests')} FROM pend)
SELECT batch_id, CAST(count(*) AS INTEGER) AS n_items, md5(string_agg(member_key, ',' ORDER BY ordinal)) AS request_id,
       'Answer each of the following ' || count(*) || ' messages.' || {NL} || {NL} ||
       string_agg('[' || ordinal || '] ' || text, {NL} || {NL} ORDER BY ordinal) AS payload
FROM b GROUP BY batch_id""")
def q_pending_requests(spark, d):
    """Batches of 10, formed of the pending members alone."""
    todo = requests.pending(turn_members(spark, d), turn_replies(spark, d))
    return requests.form(todo, 10, TURN_HEADER, F.format_string("[%d] %s", "ordinal", "text")).drop("member_keys")


@query("reply_upsert", f"""
WITH {MEMBERS_CTE},
r AS (SELECT u.member_key, a.reply, {h32('wave', 'u.member_key')} % 3 AS w FROM u JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn)
SELECT member_key, 'ok' AS status, md5(reply) AS reply_md5, CASE WHEN w = 0 THEN 2 ELSE 1 END AS wave FROM r""")
def q_reply_upsert(spark, d):
    """Reply files dropped in two waves and streamed into the versioned table: of the first wave a third has failed; the
    second brings these, and late failures of others, which must not replace an answer."""
    base = scratch_path(spark, "reply_upsert")
    all_replies = turn_replies(spark, d)
    third = F.pmod(hash32("wave", "member_key"), F.lit(3))
    lost = {"status": F.lit("failed"), "reply": F.lit(None).cast("string"), "error": F.lit("server")}
    first = all_replies.where(third != 0).unionByName(all_replies.where(third == 0).withColumns(lost))
    second = all_replies.where(third == 0).unionByName(all_replies.where(third == 1).withColumns(lost))
    for number, wave in ((1, first), (2, second)):
        requests.write_reply_files(wave.withColumn("ts", F.timestamp_seconds(F.lit(number))), f"{base}/incoming")
        requests.ingest(spark, f"{base}/incoming", f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return requests.replies_of(SnapshotTable(spark, f"{base}/table")).select(
        "member_key", "status", F.md5("reply").alias("reply_md5"), F.unix_timestamp("ts").cast("int").alias("wave"))


@query("prompt_pad", f"""
WITH {FP_BATCH_CTE},
present AS (SELECT batch_id, ordinal, row_number() OVER (PARTITION BY batch_id ORDER BY ordinal) AS j,
                   '[' || ordinal || '] Write about: ' || array_to_string({ws_tokens_sql('substr(text, 1, 1000)')}[1:5], ' ') AS line
            FROM fpb WHERE len({ws_tokens_sql('substr(text, 1, 1000)')}) % 4 <> 0),
parsed AS (SELECT batch_id, CAST(j AS INTEGER) AS ordinal,
                  CASE WHEN starts_with(line, '[' || j || ']') THEN {strip_sql("substr(line, length('[' || j || ']') + 1)")}
                       ELSE {strip_sql('line')} END AS prompt FROM present)
SELECT fpb.example_id, fpb.batch_id, fpb.ordinal,
       coalesce(parsed.prompt, 'Write a text similar to: ' || substr(fpb.text, 1, 200)) AS prompt,
       parsed.prompt IS NOT NULL AS from_reply
FROM fpb LEFT JOIN parsed ON fpb.batch_id = parsed.batch_id AND fpb.ordinal = parsed.ordinal""")
def q_prompt_pad(spark, d):
    members, req = prompt_stage(spark, d)
    rep = generate.persisted_replies(
        generate.run_requests(req, generate.StubPromptWriter(), sleep=generate.no_wait),
        scratch_path(spark, "replies_prompts"))
    return generate.padded_prompts(members, req, rep)


# --- reply parsing on replies laid out from the conversations ---------------------

def _numbered_replies(spark, d):
    c = tables.read(spark, d, "conversations")
    first_line = F.element_at(F.split("text", "\n"), 1)
    num = (F.col("turn") + 1).cast("string")
    line = (F.when(F.col("role") == "system", F.concat(F.lit("Note: "), first_line))
             .when(F.col("role") == "user", F.concat(F.lit("["), num, F.lit("] "), first_line))
             .otherwise(F.concat(num, F.lit(") "), first_line)))
    # one reply per block of 64 turns: no task collects a whole conversation
    return c.groupBy("conv_id", F.floor(F.col("turn") / 64).alias("part")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))),
                                 lambda s: s["l"]), "\n").alias("reply"))


def _fold_sql():
    def cut(p):
        return f"{strip_sql(f'substr(l.s, length({p}) + 1)')}"
    p1 = "'[' || (f.k + 1) || ']'"
    p2 = "(f.k + 1) || '.'"
    p3 = "(f.k + 1) || ')'"
    item = (f"CASE WHEN starts_with(l.s, {p1}) THEN {cut(p1)} WHEN starts_with(l.s, {p2}) THEN {cut(p2)} "
            f"WHEN starts_with(l.s, {p3}) THEN {cut(p3)} ELSE l.s END")
    return f"""
WITH RECURSIVE lines AS (
  SELECT conv_id, CAST(floor(turn / 64) AS BIGINT) AS part,
         row_number() OVER (PARTITION BY conv_id, floor(turn / 64) ORDER BY turn) AS ln,
         {strip_sql('''CASE WHEN role = 'system' THEN 'Note: ' || split_part(text, chr(10), 1)
                    WHEN role = 'user' THEN '[' || (turn + 1) || '] ' || split_part(text, chr(10), 1)
                    ELSE (turn + 1) || ') ' || split_part(text, chr(10), 1) END''')} AS s
  FROM conversations),
fold(conv_id, part, ln, k, item) AS (
  SELECT DISTINCT conv_id, part, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR) FROM lines
  UNION ALL
  SELECT f.conv_id, f.part, l.ln, f.k + CASE WHEN ({item}) <> '' THEN 1 ELSE 0 END,
         CASE WHEN ({item}) <> '' THEN ({item}) END
  FROM fold f JOIN lines l ON l.conv_id = f.conv_id AND l.part = f.part AND l.ln = f.ln + 1)
SELECT conv_id, part, CAST(k - 1 AS INTEGER) AS item_pos, item FROM fold WHERE item IS NOT NULL"""


@query("parse_numbered", _fold_sql())
def q_parse_numbered(spark, d):
    r = _numbered_replies(spark, d)
    return r.select("conv_id", "part", F.posexplode(tx.parse_numbered("reply")).alias("item_pos", "item")) \
            .select("conv_id", "part", F.col("item_pos").cast("int"), "item")


@query("parse_parts", f"""
WITH r AS (SELECT conv_id, CAST(floor(turn / 64) AS BIGINT) AS part,
                  string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn) AS reply
           FROM conversations WHERE role = 'assistant' GROUP BY conv_id, floor(turn / 64)),
p AS (SELECT conv_id, part, list_filter(list_transform(string_split(reply, '---'), lambda x: {strip_sql('x')}),
                                  lambda x: length(x) > 100) AS parts FROM r)
SELECT conv_id, part, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS part_pos,
       CAST(length(unnest(parts)) AS BIGINT) AS n_chars FROM p""")
def q_parse_parts(spark, d):
    c = tables.read(spark, d, "conversations").filter(F.col("role") == "assistant")
    r = c.groupBy("conv_id", F.floor(F.col("turn") / 64).alias("part")).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n---\n").alias("reply"))
    p = r.select("conv_id", "part", F.posexplode(tx.split_parts("reply", 100)).alias("part_pos", "body"))
    return p.select("conv_id", "part", F.col("part_pos").cast("int"), F.length("body").cast("bigint").alias("n_chars"))


@query("clean_story", f"""
WITH s AS (SELECT doc_id, {strip_sql(f"regexp_replace({strip_sql('text')}, '^(\\[[1-5]\\]|[1-5]\\.)', '')")} AS c FROM documents),
l AS (SELECT doc_id, c, string_split(c, chr(10)) AS lines FROM s)
SELECT doc_id, md5(CASE WHEN len(lines) > 2 AND length(lines[1]) < 80 AND lines[1] = {strip_sql('lines[1]')}
                        AND {strip_sql('lines[2]')} = ''
                   THEN {strip_sql("array_to_string(lines[3:], chr(10))")} ELSE c END) AS clean_md5,
       CAST(length(CASE WHEN len(lines) > 2 AND length(lines[1]) < 80 AND lines[1] = {strip_sql('lines[1]')}
                        AND {strip_sql('lines[2]')} = ''
                   THEN {strip_sql("array_to_string(lines[3:], chr(10))")} ELSE c END) AS BIGINT) AS n_chars
FROM l""")
def q_clean_story(spark, d):
    docs = tables.read(spark, d, "documents").select("doc_id", "text")
    c = docs.select("doc_id", tx.clean_story("text").alias("c"))
    return c.select("doc_id", F.md5("c").alias("clean_md5"), F.length("c").cast("bigint").alias("n_chars"))


# --- creative prompt grid, creative rows, mirror rows -----------------------------------

def _stories(spark, d, n=None):
    """All stories; a seeded sample of ``n`` only if the caller asks for one."""
    docs = filters.story_text(tables.read(spark, d, "documents").select("doc_id", "text"))
    return docs if n is None else sample.sample_n(docs, n, id_col="doc_id")


def prompt_grid(stories):
    """One machine-story request per human story: style and length drawn with
    replacement, topics without replacement inside each batch of 5."""
    ids = stories.select(F.col("doc_id").alias("example_id"))   # the story itself is not part of the request
    b = batches.assign_batches(ids, generate.STORY_BATCH)
    styles = F.array(*[F.lit(s) for s in STYLES])
    lengths = F.array(*[F.lit(s) for s in LENGTHS])
    topics = F.array(*[F.lit(t) for t in TOPICS])
    perm = F.array_sort(F.transform(topics, lambda t: F.struct(
        F.md5(F.concat(F.lit("topic:"), F.col("batch_id").cast("string"), F.lit(":"), t)).alias("h"),
        t.alias("t"))))
    x = b.select("example_id", "batch_id", "ordinal",
                 F.element_at(styles, (F.pmod(hash32("style", "example_id"), F.lit(len(STYLES))) + 1).cast("int")).alias("style"),
                 F.element_at(lengths, (F.pmod(hash32("len", "example_id"), F.lit(len(LENGTHS))) + 1).cast("int")).alias("length"),
                 F.element_at(perm, F.col("ordinal"))["t"].alias("topic"))
    return x.withColumn("prompt", F.format_string(STORY_PROMPT, "style", "length", "topic"))


PROMPT_GRID_CTE = f"""s AS (SELECT doc_id AS example_id FROM documents
           WHERE length({strip_sql('text')}) > 200 AND length({strip_sql('text')}) < 8000),
b AS (SELECT example_id, {batch_sql(5)} FROM s),
t AS (SELECT b.batch_id, t.topic, row_number() OVER (PARTITION BY b.batch_id ORDER BY md5('topic:' || b.batch_id || ':' || t.topic), t.topic) AS r
      FROM (SELECT DISTINCT batch_id FROM b) b, (SELECT unnest({_sql_list(TOPICS)}) AS topic) t),
g AS (SELECT b.example_id, b.batch_id, b.ordinal,
             {_sql_list(STYLES)}[{h32('style', 'b.example_id')} % {len(STYLES)} + 1] AS style,
             {_sql_list(LENGTHS)}[{h32('len', 'b.example_id')} % {len(LENGTHS)} + 1] AS length,
             t.topic
      FROM b JOIN t ON b.batch_id = t.batch_id AND b.ordinal = t.r),
pg AS (SELECT example_id, batch_id, ordinal, style, length, topic,
       'Write a ' || style || ' short story of about ' || length || ' words about ' || topic || '. Use vivid details and varied sentences.' AS prompt
FROM g)"""


@query("prompt_grid", f"WITH {PROMPT_GRID_CTE}\nSELECT * FROM pg")
def q_prompt_grid(spark, d):
    return prompt_grid(_stories(spark, d)).select("example_id", "batch_id", "ordinal", "style",
                                                  "length", "topic", "prompt")


def creative_rows(spark, d):
    """Human stories (label 0) and generated stories (label 1), cleaned."""
    stories = _stories(spark, d)
    grid = prompt_grid(stories)
    g = grid.groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "example_id", "prompt"))).alias("items"))
    req = g.select("batch_id",
                   generate.request_id("creative", F.transform("items", lambda s: s["example_id"].cast("string")))
                   .alias("request_id"),
                   F.array_join(F.transform("items", lambda s: F.format_string("[%d] %s", s["ordinal"], s["prompt"])),
                                "\n\n").alias("payload"))
    rep = generate.persisted_replies(
        generate.run_requests(req, generate.StubStoryWriter(), sleep=generate.no_wait),
        scratch_path(spark, "replies_stories"))
    parts = (rep.filter(F.col("status") == "ok")
             .select("request_id", F.posexplode(tx.split_parts("reply", 100)).alias("pos", "part")))
    ai = parts.select(F.conv(F.substring(F.md5(F.concat_ws(":", "request_id", F.col("pos").cast("string"))), 1, 15),
                             16, 10).cast("bigint").alias("example_id"),
                      tx.clean_story("part").alias("text"))
    ai = ai.filter(F.length("text") > 100).select(
        "example_id", "text", F.lit(1).alias("label"), F.lit("generated_creative").alias("source"),
        F.lit("creative").alias("domain"))
    # own id space: a story document may also be a base row of the pool
    human = stories.select(stable_id(F.lit("stories"), "doc_id").alias("example_id"), tx.py_strip("text").alias("text"),
                           F.lit(0).alias("label"), F.lit("stories").alias("source"),
                           F.lit("creative").alias("domain"))
    return human.unionByName(ai)


@query("creative_rows", f"""
WITH {PROMPT_GRID_CTE},
req AS (SELECT batch_id, md5('creative:' || string_agg(CAST(example_id AS VARCHAR), ',' ORDER BY ordinal) || ':{generate.TEMPLATE_VERSION}') AS request_id
        FROM pg GROUP BY batch_id),
ai AS (SELECT CAST(('0x' || substr(md5(req.request_id || ':' || CAST(pg.ordinal - 1 AS VARCHAR)), 1, 15)) AS BIGINT) AS example_id,
              1 AS label, 'generated_creative' AS source, 'creative' AS domain,
              CAST(4 * length(pg.prompt) + 3 AS BIGINT) AS n_chars
       FROM pg JOIN req ON pg.batch_id = req.batch_id),
human AS (SELECT {stable_id_sql("'stories'", 'doc_id')} AS example_id, 0 AS label, 'stories' AS source, 'creative' AS domain,
                 CAST(length({strip_sql('text')}) AS BIGINT) AS n_chars
          FROM documents WHERE doc_id IN (SELECT example_id FROM s))
SELECT * FROM human UNION ALL SELECT * FROM ai""")
def q_creative_rows(spark, d):
    return creative_rows(spark, d).select("example_id", "label", "source", "domain",
                                          F.length("text").cast("bigint").alias("n_chars"))


def mirror_job(spark, d, round_no=1, max_mirrors=None):
    """False positives (all, or a seeded sample of ``max_mirrors``) -> prompts -> padded -> texts -> mirror rows."""
    fp = fp_rows(spark, d)
    capped = fp if max_mirrors is None else sample.sample_n(fp, max_mirrors, seed=round_no)
    members, req = generate.prompt_requests(capped, round_no=round_no)
    rep1 = generate.persisted_replies(
        generate.run_requests(req, generate.StubPromptWriter(), sleep=generate.no_wait),
        scratch_path(spark, f"replies_prompts_r{round_no}"))
    prompts = generate.padded_prompts(members, req, rep1)
    treq = generate.text_requests(prompts, round_no=round_no)
    rep2 = generate.persisted_replies(
        generate.run_requests(treq, generate.StubTextWriter(), sleep=generate.no_wait),
        scratch_path(spark, f"replies_texts_r{round_no}"))
    return generate.mirror_rows(treq, rep2, round_no=round_no)


MIRROR_SQL = SCORES_CTE + f""",
fp AS (SELECT example_id, text FROM scored WHERE label = 0 AND pred = 1 AND text IS NOT NULL AND text <> ''),
fpb AS (SELECT example_id, text, {batch_sql(10)} FROM fp),
present AS (SELECT batch_id, ordinal, row_number() OVER (PARTITION BY batch_id ORDER BY ordinal) AS j,
                   '[' || ordinal || '] Write about: ' || array_to_string({ws_tokens_sql('substr(text, 1, 1000)')}[1:5], ' ') AS line
            FROM fpb WHERE len({ws_tokens_sql('substr(text, 1, 1000)')}) % 4 <> 0),
parsed AS (SELECT batch_id, CAST(j AS INTEGER) AS ordinal,
                  CASE WHEN starts_with(line, '[' || j || ']') THEN {strip_sql("substr(line, length('[' || j || ']') + 1)")}
                       ELSE {strip_sql('line')} END AS prompt FROM present),
pp AS (SELECT fpb.example_id, fpb.batch_id, fpb.ordinal,
              coalesce(parsed.prompt, 'Write a text similar to: ' || substr(fpb.text, 1, 200)) AS prompt
       FROM fpb LEFT JOIN parsed ON fpb.batch_id = parsed.batch_id AND fpb.ordinal = parsed.ordinal),
tr AS (SELECT batch_id, md5('1t:' || string_agg(CAST(example_id AS VARCHAR), ',' ORDER BY ordinal) || ':{generate.TEMPLATE_VERSION}') AS request_id
       FROM pp GROUP BY batch_id),
parts AS (SELECT pp.example_id AS parent_id, pp.ordinal, tr.request_id, split_part(pp.prompt, chr(10), 1) AS p
          FROM pp JOIN tr ON pp.batch_id = tr.batch_id),
reps AS (SELECT *, CAST(greatest(3, ceil(160.0 / (length(p) + 1))) AS INTEGER) AS k FROM parts)"""


@query("mirrors", f"""
WITH {MIRROR_SQL}
SELECT CAST(('0x' || substr(md5(request_id || ':' || CAST(ordinal - 1 AS VARCHAR)), 1, 15)) AS BIGINT) AS example_id,
       1 AS label, 'mirror' AS source, 'mirror' AS domain, parent_id, 1 AS round,
       CAST(length({strip_sql("'Text ' || ordinal || '. ' || repeat(p || ' ', k - 1) || p")}) AS BIGINT) AS n_chars
FROM reps""")
def q_mirrors(spark, d):
    return mirror_job(spark, d).select("example_id", "label", "source", "domain", "parent_id", "round",
                                       F.length("text").cast("bigint").alias("n_chars"))


@query("reply_ingest", f"WITH {PAYLOAD_CTE}\nSELECT request_id, status, attempts, error FROM status")
def q_reply_ingest(spark, d):
    """Replies dropped twice into a folder (a retried worker) and ingested by two
    incremental streaming runs: each request appears once, no file is read twice."""
    from ..session import scratch_path
    from ..streaming import replies as rs
    _, req = prompt_stage(spark, d)
    base = scratch_path(spark, "reply_ingest")
    generate.run_requests(req, generate.FlakyGenerator(generate.StubPromptWriter()),
                          sleep=generate.no_wait).write.parquet(f"{base}/sent")
    sent = spark.read.parquet(f"{base}/sent")  # persisted before use: no second call
    rs.write_reply_files(sent, f"{base}/incoming")
    rs.run_ingest(spark, f"{base}/incoming", f"{base}/table", f"{base}/_checkpoint")
    rs.write_reply_files(sent, f"{base}/incoming")
    table = rs.run_ingest(spark, f"{base}/incoming", f"{base}/table", f"{base}/_checkpoint")
    return table.select("request_id", "status", "attempts", "error")
