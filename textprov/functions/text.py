"""Text column expressions with Python string semantics, JVM-side only.

All functions return :class:`pyspark.sql.Column` built from built-in Spark
functions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's rules):
#   white space of Python's str.strip(): Unicode White_Space plus U+001C..U+001F
#   numbering prefixes removed from generated stories: [1] [2] [3] [4] [5] 1. 2. 3. 4. 5.
#   reply part separator: ---
#   title rule: more than 2 lines, first line shorter than 80 characters and
#   already stripped, second line blank
PY_SPACE_CLASS = r"[\s\x{1c}-\x{1f}]"
_STRIP_RE = r"(?U)\A" + PY_SPACE_CLASS + r"+|" + PY_SPACE_CLASS + r"+\z"
STORY_PREFIX_RE = r"^(\[[1-5]\]|[1-5]\.)"
PART_SEPARATOR = "---"
TITLE_MAX_CHARS = 80


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(col) -> Column:
    """``str.strip()``: remove the 29 characters Python treats as white space."""
    return F.regexp_replace(_c(col), _STRIP_RE, "")


def py_len(col) -> Column:
    """``len(str)`` in code points."""
    return F.length(_c(col))


def stripped_len(col) -> Column:
    return F.length(py_strip(col))


def ws_tokens(col) -> Column:
    """White-space tokens: ``str.split()`` on ASCII white space, no empties."""
    return F.filter(F.split(_c(col), r"\s+"), lambda t: t != F.lit(""))


def ws_token_count(col) -> Column:
    return F.size(ws_tokens(col))


def first_nonempty(*cols) -> Column:
    """``a or b or c or ''``: first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols], F.lit(""))


def label_from_generator(col, human_value: str = "human") -> Column:
    """0 when the generator names a human writer, else 1 (null → 1, as ``!=``)."""
    return F.when(_c(col) == F.lit(human_value), F.lit(0)).otherwise(F.lit(1))


def prefix_question(question, answer) -> Column:
    """``f"{q}\\n{a}" if q else a`` with a missing question read as ''."""
    q = F.coalesce(_c(question), F.lit(""))
    return F.when(q != F.lit(""), F.concat(q, F.lit("\n"), _c(answer))).otherwise(_c(answer))


def truncate_chars(col, n: int) -> Column:
    """``s[:n]`` in code points."""
    return F.substring(_c(col), 1, n)


def strip_story_prefix(col) -> Column:
    """Strip, remove one leading ``[k]`` / ``k.`` (k = 1..5) once, strip again."""
    return py_strip(F.regexp_replace(py_strip(col), STORY_PREFIX_RE, ""))


def remove_title(col) -> Column:
    """Drop a title line and the blank line after it (rule above)."""
    c = _c(col)
    lines = F.split(c, "\n")
    first = F.get(lines, 0)
    second = F.get(lines, 1)
    is_title = (
        (F.size(lines) > 2)
        & (F.length(first) < TITLE_MAX_CHARS)
        & (first == py_strip(first))
        & (py_strip(second) == F.lit(""))
    )
    rest = F.array_join(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return F.when(is_title, py_strip(rest)).otherwise(c)


def clean_story(col) -> Column:
    return remove_title(strip_story_prefix(col))


def split_parts(col, min_len: int = 100, sep: str = PART_SEPARATOR) -> Column:
    """Reply parts: split on ``---``, strip each, keep those longer than ``min_len``."""
    parts = F.transform(F.split(_c(col), sep), lambda p: py_strip(p))
    return F.filter(parts, lambda p: F.length(p) > F.lit(min_len))


def parse_numbered(col, mode: str = "reference") -> Column:
    """Parse a numbered reply into an array of items.

    ``reference``: lines are stripped, blank lines skipped; a line starting with
    ``[k]``, ``k.`` or ``k)`` where k = items accepted so far + 1 loses that
    prefix; a line empty after that is skipped.  A preamble line therefore
    shifts every later number (kept on purpose, it is the observed rule).
    ``by_number``: any leading ``[n]``, ``n.`` or ``n)`` is removed.
    """
    lines = F.split(_c(col), "\n")
    if mode == "by_number":
        items = F.transform(
            lines, lambda l: py_strip(F.regexp_replace(py_strip(l), r"^(\[\d+\]|\d+[.)])", "")))
        return F.filter(items, lambda s: s != F.lit(""))
    if mode != "reference":
        raise ValueError(f"unknown mode {mode!r}")

    def step(acc, line):
        s = py_strip(line)
        k = (F.size(acc) + F.lit(1)).cast("string")
        p1 = F.concat(F.lit("["), k, F.lit("]"))
        p2 = F.concat(k, F.lit("."))
        p3 = F.concat(k, F.lit(")"))

        def cut(p):
            return py_strip(F.substring(s, F.length(p) + F.lit(1), 1 << 30))

        item = (F.when(F.startswith(s, p1), cut(p1))
                 .when(F.startswith(s, p2), cut(p2))
                 .when(F.startswith(s, p3), cut(p3))
                 .otherwise(s))
        return F.when(item == F.lit(""), acc).otherwise(F.concat(acc, F.array(item)))

    return F.aggregate(lines, F.array().cast("array<string>"), step)
