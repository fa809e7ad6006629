"""Randomised differential tests: Spark expressions against their Python definitions,
and the exact split under a hot stratum against a brute-force ranking."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from textprov.functions import text as tx
from textprov.operators import split

ALPHABET = ["a", "b", "Z", "1", "2", "[", "]", ".", ")", "-", "-", "-", " ", " ", "\t", "\n", "\n",
            " ", " ", "　", "\x1c", "\x85", "é", "ß"]


def _random_strings(seed, n=300, max_len=60):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        k = rnd.randint(0, max_len)
        s = "".join(rnd.choice(ALPHABET) for _ in range(k))
        if rnd.random() < 0.3:  # numbered lines like a reply
            s = "\n".join(f"{rnd.choice(['[', ''])}{rnd.randint(1, 4)}{rnd.choice(['] ', '. ', ') ', ' '])}{s[:10]}"
                          for _ in range(rnd.randint(1, 5)))
        out.append(s)
    return out


def test_text_rules_match_python(spark):
    xs = _random_strings(11)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(xs)], "i int, t string")
    rows = df.select("i", tx.py_strip("t").alias("strip"), tx.py_len("t").alias("len"),
                     tx.split_parts("t", 3).alias("parts"),
                     F.regexp_like("t", F.lit("(?U)[^\\s\\x{1c}-\\x{1f}]")).alias("nonempty")).collect()
    for r in rows:
        s = xs[r.i]
        assert r.strip == s.strip(), repr(s)
        assert r.len == len(s)
        assert r.parts == [p.strip() for p in s.split("---") if len(p.strip()) > 3], repr(s)
        assert r.nonempty == (len(s.strip()) > 0), repr(s)


# A reply and the items that it holds, written by hand.
REPLIES = [
    ("", []),
    ("   \n\t\n", []),
    ("[1] one\n[2] two", ["one", "two"]),
    ("1. one\n2. two\n3. three", ["one", "two", "three"]),
    ("1) one\n2) two", ["one", "two"]),
    ("  [1]   padded  \n\n\n  [2] more\t", ["padded", "more"]),
    ("[1] one\n2. two\n3) three", ["one", "two", "three"]),
    ("[2] the number is not the next one", ["[2] the number is not the next one"]),
    ("Here you are:\n[1] one\n[2] two", ["Here you are:", "[1] one", "[2] two"]),
    ("[1]\n[1] one", ["one"]),
    ("[1] one\n[2]\n[2] two", ["one", "two"]),
    ("[1] [1] twice", ["[1] twice"]),
    ("plain\nlines", ["plain", "lines"]),
    ("1.no space\n2)none either", ["no space", "none either"]),
    ("[1] a\n[2] b\n[3] c\n[4] d\n[5] e\n[6] f\n[7] g\n[8] h\n[9] i\n[10] j\n[11] k", list("abcdefghijk")),
    ("10. too early", ["10. too early"]),
    ("1 no sign\n2- other sign", ["1 no sign", "2- other sign"]),
    ("[1]one\r\n[2]two\r\n", ["one", "two"]),
    ("é. accent\n[2] ß", ["é. accent", "ß"]),
    ("[1] one\n---\n[3] three", ["one", "---", "three"]),
]


def test_numbered_replies(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REPLIES)], "i int, t string")
    got = {r.i: r.num for r in df.select("i", tx.parse_numbered("t").alias("num")).collect()}
    for i, (reply, items) in enumerate(REPLIES):
        assert got[i] == items, repr(reply)


def test_numbered_replies_of_any_length(spark):
    """Items without digits or brackets come back as they were, whatever numbering style their line has."""
    rnd = random.Random(12)
    styles = ["[{}] {}", "{}. {}", "{}) {}", "[{}]{}", "  {}.   {}  "]
    made = [["".join(rnd.choice("abcß -") for _ in range(8)).strip() or "x" for _ in range(rnd.randint(1, 30))] for _ in range(60)]
    replies = ["\n".join(rnd.choice(styles).format(k, item) + rnd.choice(["", "\n", "\n \n"]) for k, item in enumerate(items, 1)) for items in made]
    df = spark.createDataFrame(list(enumerate(replies)), "i int, t string")
    got = {r.i: r.num for r in df.select("i", tx.parse_numbered("t").alias("num")).collect()}
    assert [got[i] for i in range(len(made))] == made


def test_split_exact_under_a_hot_stratum(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(6000):
        if i < 2500:
            st = "1_hot"  # more than a third of all rows in one stratum
        else:
            st = f"{rnd.randint(0, 1)}_s{rnd.randint(0, 40)}"
        rows.append((i * 7 + 3, st))
    df = spark.createDataFrame(rows, "example_id long, stratum string")
    got = {r.example_id: r.split for r in split.stratified_split(df, stratum=F.col("stratum")).collect()}

    def md5(seed, i):
        return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()

    def quota(counts, frac, seed):
        total = sum(counts.values())
        t = math.ceil(frac * total)
        base = {k: math.floor(n * t / total) for k, n in counts.items()}
        rem = {k: round(n * t / total - base[k], 9) for k, n in counts.items()}
        order = sorted(counts, key=lambda k: (-rem[k], md5(seed, k), k))
        left = t - sum(base.values())
        return {k: base[k] + (1 if r < left else 0) for r, k in enumerate(order)}

    by = {}
    for i, st in rows:
        by.setdefault(st, []).append(i)
    q1 = quota({k: len(v) for k, v in by.items()}, 0.2, 42)
    held = {k: sorted(v, key=lambda i: (md5(42, i), i))[:q1[k]] for k, v in by.items()}
    q2 = quota({k: len(v) for k, v in held.items()}, 0.5, 43)
    want = {i: "train" for i, _ in rows}
    for k, v in held.items():
        test = set(sorted(v, key=lambda i: (md5(43, i), i))[:q2[k]])
        for i in v:
            want[i] = "test" if i in test else "val"
    assert got == want
