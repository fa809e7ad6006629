"""Conversation repair: the decoder against a search over all edits, the whole job against plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from textprov.llm import dialogue
from textprov.llm.dialogue import Decoder

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
COST = {"K": 0, "R": 3, "D": 4, "I": 3}


def search(rows):
    """Least (cost, audit) over all edits: shortest paths over (rows used, last initial, audit)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, made = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, list(made)
        if (i, last) in done:
            continue
        done.add((i, last))
        for role in ("user", "assistant"):
            if (last, role[0]) in NEXT:
                heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], made + ((role, ""),)))
        if i < len(rows):
            fault, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, made))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if (last, role[:1]) in NEXT:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], made + ((role, text),)))
                for new in ("user", "assistant"):
                    if (last, new[0]) in NEXT:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, new[0], made + ((new, text),)))
    raise AssertionError


def decode(rows):
    d = Decoder()
    out = []
    for fault, role, text in rows:
        out += d.push((fault, role, None, text))
    out += d.finish()
    cost = sum(COST[e] + (3 if r and r[0] == "truncated" and e != "D" else 0) for e, _, r in out)
    return cost, "".join(e for e, _, _ in out), [(role, r[3] if r else "") for e, role, r in out if e != "D"], d


@pytest.mark.parametrize("seed", range(4))
def test_decoder_equals_search(seed):
    rnd = random.Random(seed)
    for _ in range(400):
        rows = [(rnd.choice([None, None, None, "truncated", "blank", "duplicate"]),
                 rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "sage"]), str(i))
                for i in range(rnd.randint(0, 12))]
        cost, audit, made, _ = decode(rows)
        assert (cost, audit, made) == search(rows), rows
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in made))


def test_few_edits_are_held_however_long_the_conversation():
    rnd = random.Random(5)
    rows = [(rnd.choice([None] * 8 + ["truncated"]), rnd.choice(["user", "assistant"]), "x") for _ in range(20_000)]
    assert decode(rows)[3].held < 60


def by_hand(rows):
    """The contract in plain Python over (conv_id, turn, role, text)."""
    groups = {}
    for conv, turn, role, text in rows:
        g = groups.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        g += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, g in groups.items():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in g:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            faulty.append((fault, role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        cost, audit, made = search(faulty)
        turns = [t for t, _, _ in g if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


def run(df):
    rows = dialogue.summaries(dialogue.repair(dialogue.damage(df))).collect()
    found = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


SCHEMA = "conv_id long, turn long, role string, text string"


def test_job_equals_plain_python(spark):
    rnd = random.Random(9)
    rows = [(c if c else None, rnd.choice([None, *range(8)]), rnd.choice(["system", "user", "assistant", None, "", "sage"]),
             rnd.choice(["Hello.", "Yes!", "no end", " \t", None, "Why?  ", "dot. ", "é."])) for c in range(120) for _ in range(rnd.randint(1, 10))]
    assert run(spark.createDataFrame(rows, SCHEMA)) == by_hand(rows)


def test_given_table_equals_plain_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert run(df) == by_hand([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_empty_long_repeated_and_clashing(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == {}
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "w " * 200_000 + f"{t}.") for t in range(6)]
    rows += [(2, 1, "user", "same.")] * 9 + [(3, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.select("*", *[F.lit("x").alias(c) for c in ("lost", "kind", "digest", "fault", "edit", "was_role")])
    assert run(clash) == run(df) == by_hand(rows)


def test_repair_gives_the_turns_themselves(spark):
    rows = [(7, 0, "user", "Hi."), (7, 1, "user", "Still there?"), (7, 2, "assistant", "")]
    got = [tuple(r) for r in dialogue.repair(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert [(e, r, t) for _, _, _, _, e, r, t in got] == [("K", "user", "Hi."), ("R", "assistant", "Still there?"), ("D", None, None)]
    assert [r[3] for r in got] == [None, None, "blank"]
