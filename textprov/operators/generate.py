"""Generation requests as a batch Spark job with a pluggable text generator.

Flow for one round of mirrors (each arrow is a DataFrame):
  false positives -> seeded cap -> batches of 10 (global row numbers) ->
  numbered payload per batch -> generator (mapInPandas, retries) ->
  persisted replies -> parse numbered lines -> pad missing prompts ->
  second payload -> generator -> split parts on '---' -> rows with lineage.

The generator is any picklable object with ``__call__(payload: str) -> str``
that raises the error classes below.  Replies are written to a table keyed by
``request_id`` before they are used: a recomputed stage re-reads them instead
of calling the generator again, and a restarted job only sends requests
missing from that table (``pending_requests``).
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_numbered, split_parts, truncate_chars
from .batches import assign_batches

# Item format of a prompt-writing request and of a text request,
# the fallback prompt, the character caps, items per request, retry attempts,
# reply minimum length
PROMPT_ITEM = '[{k}]\n"""{text}"""'      # text cut at 1000 characters
TEXT_ITEM = "[{k}] {prompt}"
FALLBACK_PROMPT = "Write a text similar to: "  # followed by the first 200 characters
PROMPT_INPUT_CHARS = 1000
FALLBACK_CHARS = 200
MIRROR_BATCH = 10
STORY_BATCH = 5
MAX_ATTEMPTS = 3
MIN_PART_CHARS = 100
TEMPLATE_VERSION = "v1"

# Our own instruction wording (not a reference value; only the item format is).
PROMPT_HEADER = ("Below are {n} texts. For each one, write a one or two sentence request that would "
                 "lead a writing assistant to produce a similar text. Answer with the requests only, "
                 "one per line, numbered [1] to [{n}].")
TEXT_HEADER = ("Write {n} independent texts, one for each request below, each of {words} words. "
               "Put a line with --- between two texts.")


class GeneratorError(Exception):
    kind = "other"


class RateLimited(GeneratorError):
    kind = "rate_limit"


class ServerFailure(GeneratorError):
    kind = "server"


class ClientFailure(GeneratorError):
    kind = "client"


class AuthFailure(GeneratorError):
    kind = "auth"


class EmptyReply(GeneratorError):
    kind = "empty"


class Waits(NamedTuple):
    """Seconds that a caller's back-off starts from, by kind of error."""

    rate_limit: float
    server: float
    other: float


# Waits of the mirror requests and of the story requests
MIRROR_WAITS = Waits(5.0, 3.0, 1.0)
STORY_WAITS = Waits(10.0, 5.0, 2.0)


def backoff_seconds(kind: str, attempt: int, waits: Waits = MIRROR_WAITS) -> float:
    """Wait before the next attempt (attempt counts from 0)."""
    if kind == "rate_limit":
        return 2 ** (attempt + 1) * waits.rate_limit
    if kind == "server":
        return 2 ** (attempt + 1) * waits.server
    return 2 ** attempt * waits.other


def call_with_retry(gen: Callable[[str], str], payload: str, attempts: int = MAX_ATTEMPTS,
                    sleep: Callable[[float], None] = time.sleep,
                    waits: Waits = MIRROR_WAITS) -> tuple[str | None, str, int, str | None]:
    """Return ``(reply, status, attempts_used, error_kind)``; never raises.

    An empty reply counts as an error; an authentication error stops at once.
    """
    last = None
    for a in range(attempts):
        try:
            reply = gen(payload)
            if reply is None or reply == "":
                raise EmptyReply("empty reply")
            return reply, "ok", a + 1, None
        except AuthFailure:
            return None, "failed", a + 1, "auth"
        except GeneratorError as e:
            last = e.kind
        except Exception:  # noqa: BLE001 - any client library error
            last = "other"
        if a < attempts - 1:
            sleep(backoff_seconds(last, a, waits))
    return None, "failed", attempts, last


REPLY_SCHEMA = "request_id string, reply string, status string, attempts int, error string"


def no_wait(seconds: float) -> None:
    """Back-off for local generators (stubs): retry at once."""


def run_requests(requests: DataFrame, gen: Callable[[str], str], max_parallel: int | None = None,
                 sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Call the generator once per request row (``request_id``, ``payload``).

    ``max_parallel`` caps the number of concurrent tasks (the total request
    rate is tasks x per-task rate).  Speculative execution should be off for
    this stage so that no request is sent twice.
    """
    x = requests.select("request_id", "payload")
    if max_parallel:
        x = x.repartition(max_parallel, "request_id")

    def fn(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = [call_with_retry(gen, p, sleep=sleep) for p in pdf["payload"]]
            yield pd.DataFrame({
                "request_id": pdf["request_id"].values,
                "reply": [o[0] for o in out], "status": [o[1] for o in out],
                "attempts": pd.array([o[2] for o in out], dtype="int32"),
                "error": [o[3] for o in out]})
    return x.mapInPandas(fn, REPLY_SCHEMA)


def persisted_replies(replies: DataFrame, path: str) -> DataFrame:
    """Write replies (keyed by request_id) and read them back before any use.

    A stage recomputed after a lost executor then reads the stored replies
    instead of calling the generator a second time.
    """
    replies.write.mode("overwrite").parquet(path)
    return replies.sparkSession.read.parquet(path)


def pending_requests(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Planned requests without a successful reply yet (resume)."""
    ok = done.filter(F.col("status") == "ok").select("request_id")
    return planned.join(ok, "request_id", "left_anti")


# --- request construction --------------------------------------------------------

def request_id(round_no, member_ids: Column) -> Column:
    """md5(round : ids in order : template version) — idempotent across retries."""
    return F.md5(F.concat(F.lit(f"{round_no}:"), F.array_join(member_ids, ","),
                          F.lit(f":{TEMPLATE_VERSION}")))


def prompt_requests(texts: DataFrame, round_no: int = 1, batch_size: int = MIRROR_BATCH,
                    id_col: str = "example_id", seed=42) -> tuple[DataFrame, DataFrame]:
    """Batch texts and build one prompt-writing payload per batch.

    Returns ``members`` (one row per text with its batch and ordinal) and
    ``requests`` (one row per batch).  The grouping is per batch: at most
    ``batch_size`` rows per group.
    """
    # only the part of a text that enters the request is shuffled
    texts = texts.select(id_col, truncate_chars("text", PROMPT_INPUT_CHARS).alias("text"))
    members = assign_batches(texts, batch_size, seed=seed, id_col=id_col).select(id_col, "text", "batch_id", "ordinal")
    item = F.format_string('[%d]\n"""%s"""', F.col("ordinal"), F.col("text"))
    g = members.groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", F.col(id_col).alias("id"), item.alias("item"))))
        .alias("items"))
    n = F.size("items")
    header = F.format_string(PROMPT_HEADER.replace("{n}", "%1$d"), n)
    body = F.array_join(F.transform("items", lambda s: s["item"]), "\n\n")
    req = g.select("batch_id", n.alias("n_items"),
                   request_id(round_no, F.transform("items", lambda s: s["id"].cast("string")))
                   .alias("request_id"),
                   F.concat(header, F.lit("\n\n"), body).alias("payload"))
    return members, req


def padded_prompts(members: DataFrame, requests: DataFrame, replies: DataFrame,
                   id_col: str = "example_id", mode: str = "reference") -> DataFrame:
    """One prompt per member: parsed reply line k, else the fallback from its text.

    A failed request yields only fallbacks (the reference skips the batch; we
    keep going with the fallback prompt and mark ``from_reply`` false).
    """
    rep = requests.select("batch_id", "request_id").join(
        replies.filter(F.col("status") == "ok").select("request_id", "reply"), "request_id", "left")
    parsed = rep.select("batch_id", F.posexplode_outer(parse_numbered("reply", mode)).alias("_p", "prompt"))
    parsed = parsed.filter(F.col("_p").isNotNull()).select(
        "batch_id", (F.col("_p") + 1).cast("int").alias("ordinal"), "prompt")
    j = members.join(parsed, ["batch_id", "ordinal"], "left")
    fb = F.concat(F.lit(FALLBACK_PROMPT), truncate_chars("text", FALLBACK_CHARS))
    return j.select(id_col, "batch_id", "ordinal",
                    F.coalesce(F.col("prompt"), fb).alias("prompt"),
                    F.col("prompt").isNotNull().alias("from_reply"))


def text_requests(prompts: DataFrame, round_no: int = 1, words: str = "100-400",
                  id_col: str = "example_id") -> DataFrame:
    """One text-writing payload per batch from its (padded) prompts."""
    item = F.format_string("[%d] %s", F.col("ordinal"), F.col("prompt"))
    g = prompts.groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", F.col(id_col).alias("id"), item.alias("item"))))
        .alias("items"))
    n = F.size("items")
    header = F.format_string(TEXT_HEADER.replace("{n}", "%1$d").replace("{words}", "%2$s"), n, F.lit(words))
    return g.select("batch_id", n.alias("n_items"),
                    F.transform("items", lambda s: s["id"]).alias("member_ids"),
                    request_id(f"{round_no}t", F.transform("items", lambda s: s["id"].cast("string")))
                    .alias("request_id"),
                    F.concat(header, F.lit("\n\n"),
                             F.array_join(F.transform("items", lambda s: s["item"]), "\n\n")).alias("payload"))


def mirror_rows(text_reqs: DataFrame, replies: DataFrame, round_no: int = 1,
                min_chars: int = MIN_PART_CHARS) -> DataFrame:
    """Reply parts -> rows ``(text, label 1, source/domain 'mirror', parent_id, round)``.

    Part i is linked to the i-th member of its batch; surplus parts get a null
    parent (the reference keeps them without any link).
    """
    r = text_reqs.join(replies.filter(F.col("status") == "ok").select("request_id", "reply"), "request_id")
    parts = r.select("request_id", "member_ids",
                     F.posexplode(split_parts("reply", min_chars)).alias("_p", "text"))
    parent = F.try_element_at("member_ids", (F.col("_p") + 1).cast("int"))
    return parts.select(
        F.conv(F.substring(F.md5(F.concat_ws(":", "request_id", F.col("_p").cast("string"))), 1, 15), 16, 10)
        .cast("bigint").alias("example_id"),
        "text", F.lit(1).alias("label"), F.lit("mirror").alias("source"), F.lit("mirror").alias("domain"),
        parent.cast("bigint").alias("parent_id"), F.lit(round_no).alias("round"), "request_id")


# --- deterministic offline generators (default and tests) -----------------------------

_ITEM_RE = re.compile(r'^\[(\d+)\]\n"""(.*?)"""$', re.S | re.M)
_LINE_RE = re.compile(r"^\[(\d+)\] (.*)$", re.M)


class StubPromptWriter:
    """Answers a prompt-writing request: line ``[k] Write about: <first 5 words>``.

    Items whose quoted text has a word count divisible by ``drop_mod`` get no
    line, which exercises the padding rule.
    """

    def __init__(self, drop_mod: int = 4):
        self.drop_mod = drop_mod

    def __call__(self, payload: str) -> str:
        lines = []
        for k, txt in _ITEM_RE.findall(payload):
            if self.drop_mod and len(txt.split()) % self.drop_mod == 0:
                continue
            lines.append(f"[{k}] Write about: {' '.join(txt.split()[:5])}")
        return "\n".join(lines)


class StubTextWriter:
    """Answers a text request with one part per prompt, separated by ``---``."""

    def __call__(self, payload: str) -> str:
        parts = []
        for k, prompt in _LINE_RE.findall(payload):
            reps = max(3, -(-160 // max(1, len(prompt) + 1)))  # long enough to pass the 100-character rule
            body = " ".join([prompt] * reps)
            parts.append(f"Text {k}. {body}")
        return "\n---\n".join(parts)


class StubStoryWriter:
    """Answers a story request: ``[k] Title\\n\\nstory`` parts separated by ``---``."""

    def __call__(self, payload: str) -> str:
        parts = []
        for k, prompt in _LINE_RE.findall(payload):
            words = prompt.split()
            title = " ".join(words[:4]).title()
            body = " ".join(words * 4)
            parts.append(f"[{k}] {title}\n\n{body}")
        return "\n---\n".join(parts)


class FlakyGenerator:
    """Wraps a generator with failures decided by the payload's md5 first hex digit.

    0-3: one rate-limit error, then the reply; 4: server errors every time;
    f: authentication error; otherwise the reply at once.
    """

    def __init__(self, inner: Callable[[str], str]):
        self.inner = inner
        self.seen: dict[str, int] = {}

    def __call__(self, payload: str) -> str:
        h = hashlib.md5(payload.encode("utf-8")).hexdigest()[0]
        n = self.seen.get(payload, 0)
        self.seen[payload] = n + 1
        if h in "0123" and n == 0:
            raise RateLimited("429")
        if h == "4":
            raise ServerFailure("503")
        if h == "f":
            raise AuthFailure("bad key")
        return self.inner(payload)
