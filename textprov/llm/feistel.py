"""PII: format-preserving Feistel pseudonyms.

Values found by pattern and validated (check digits, octets, calendar dates)
are replaced by a keyed permutation of their own format, so that equal values
get equal pseudonyms in every document and different values different ones,
without any table of values.

* numbers (cards, phones, account numbers) and the identifying part of e-mail addresses and keyed
  secrets: a balanced Feistel network over the characters; each round adds a keyed hash of one half
  to the other half, within the class of each character (digit, small letter, capital);
* card numbers keep their first digit and get a new check digit, IBANs keep their country and get new
  check digits, so both validate again; known prefixes of secrets stay;
* social security numbers, IPv4 addresses and dates: the valid values are numbered without gaps and the
  same network permutes two numbers: area (898) and group with serial (99 x 9,999); two halves of the address, where
  host addresses stay host addresses and reserved ones (0., 127., 224. and above) stay reserved; 73,049 = 17 x 4,297 days
  from 1900 to 2099.

The whole operator is a map of SQL expressions: no shuffle, and the cost of the
network is paid per value found.  A text is cut at its values by ``split`` and
joined again with the pseudonyms.  Next to other numbers a card is found by trying the usual
groupings at every group of digits, so that neither hides the other.

Not found: IPv6 addresses, phone numbers of ten digits without any separator, dates with month names of
other languages than English.

Defined results: null text stays null with 0 values; values that do not
validate stay; identical rows get identical results; an empty table gives an
empty result; other columns pass through unchanged, whatever their names; where two kinds
could start at one place, the first in the order of ``CLEAR`` is tried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8
DAYS = (17, 4297)  # 1900-01-01 to 2099-12-31
MONTHS = "January February March April May June July August September October November December".split()

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z]{2,}"
IPV4 = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"
ISO_DATE = r"(?<![\w.\-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\w]|-\d)"
YMD_DATE = r"(?<![\w./])(?:19|20)\d\d/(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])(?![\w]|/\d)"
DAY_MONTH = rf"(?<![\w.])(?:0[1-9]|[12]\d|3[01]|[1-9]) (?:{'|'.join(MONTHS)}) (?:19|20)\d\d(?!\w)"
MONTH_DAY = rf"(?<!\w)(?:{'|'.join(MONTHS)}) (?:0[1-9]|[12]\d|3[01]|[1-9]), (?:19|20)\d\d(?!\w)"
IBAN = r"(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w]|[.\-@]\w)"
DMY_DATE = r"(?<![\w./])(?:0?[1-9]|[12]\d|3[01])[./](?:0?[1-9]|1[0-2])[./](?:19|20)\d\d(?![\w]|[./]\d)"
CARD = r"(?<![\w.])\d(?:[ \-]?\d){12,18}(?![\w]|\.\d)"
SSN = r"(?<![\w\-])(?!000|666|9\d\d)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w]|-\d)"
PHONE = (r"(?<![\w.+])(?:\+\d{1,3}[ .\-]?(?:\(\d{2,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}"
         r"|\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}|(?<!\d )0\d{1,4}(?: \d{2,4}){2,4})(?![\w]|\.\d)")
# forms whose borders are clear, cut out before any card is looked for
CLEAR_PHONE = (r"(?<![\w.+])\+(?=(?:[ .\-]?\(?\d\)?){9,15}(?![ .\-()]?\d))\d{1,3}[ .\-]?(?:\(\d{2,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?![\w]|[ .\-]\d)"
               r"|(?<![\w.+])\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?![\w]|[.\-]\d)|(?<![\w.+\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w]|[.\-]\d)"
               r"|(?<![\w.+\-])(?<!\d )0(?=(?: ?\d){8,11}(?! ?\d))\d{1,4}(?: \d{2,4}){2,4}(?![\w]|[ .\-]\d)")
SECRET = (r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_\-]?key)\s?[=:]\s?\"?[A-Za-z0-9+/_\-]{8,}|\bAKIA[0-9A-Z]{16}\b"
          r"|\bgh[pousr]_[A-Za-z0-9]{20,}\b|\bsk[_\-](?:(?:live|test|proj)[_\-])?[A-Za-z0-9]{16,}\b")
# what stays of a secret: its name, or the prefix that tells its kind
SECRET_NAME = r"^(?:[A-Za-z_\-]+\s?[=:]\s?\"?|AKIA|gh[pousr]_|sk[_\-](?:(?:live|test|proj)[_\-])?)"
CLEAR = "|".join((EMAIL, IPV4, ISO_DATE, YMD_DATE, DMY_DATE, DAY_MONTH, MONTH_DAY, IBAN, SSN, CLEAR_PHONE, SECRET))
# digit groups that hold a card perhaps; a card in it has one of the groupings, tried in this order
RUN = r"(?<![\w.])\+?\d(?:[ \-]?\d){12}[0-9 \-]*(?![\w]|\.\d)"
GROUPINGS = tuple(f"^(?:{g})(?![A-Za-z0-9_]|\\.[0-9])" for g in (
    "[0-9]{13,19}", "[0-9]{4}(?:[ -][0-9]{4}){3}", "[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}", "[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,3}",
    "[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}", "[0-9]{4}(?:[ -][0-9]{3}){3}", "[0-9]{8}[ -][0-9]{8}", "[0-9]{6}[ -][0-9]{7,13}"))
MOST_GROUPS = 5
# any other grouping: all the digits that stand together
WHOLE = r"(?<![\w.])(?<!\d[ \-])\d(?:[ \-]?\d){12,18}(?![\w]|\.\d|[ \-]\d)"
LOOSE = f"{SSN}|{PHONE}"


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def luhn_sum(digits: str, from_right: int) -> str:
    """Luhn sum of a digit string whose last digit is number ``from_right`` from the right (from 0)."""
    return (f"aggregate(sequence(1, length({digits})), 0, (s, j) -> s + {_let(f'int(substr({digits}, j, 1))', 'c', f'''
        if((length({digits}) - j + {from_right}) % 2 = 0, c, if(c > 4, 2 * c - 9, 2 * c))''')})")


def feistel_text(value: str, kind: str, key: str, rounds: int = ROUNDS) -> str:
    """Permutation of the strings with the same class at every place (digits, small letters, capitals)."""
    mixed = f"""if(length(h.l) = 0, '', array_join(transform(sequence(1, length(h.l)), j -> {_let(
        f"int(conv(substr({_hash('h.r')}, 2 * ((j - 1) % 64) + 1, 2), 16, 10))", 'k', _let('ascii(substr(h.l, j, 1))', 'c',
        "case when c between 48 and 57 then chr(48 + (c - 48 + k) % 10) when c between 97 and 122 "
        "then chr(97 + (c - 97 + k) % 26) when c between 65 and 90 then chr(65 + (c - 65 + k) % 26) "
        "else substr(h.l, j, 1) end"))}), ''))"""
    mixed = mixed.replace("{key}", _q(key)[1:-1]).replace("{kind}", kind)
    return f"""aggregate(sequence(1, {rounds}), named_struct('l', left({value}, div2({value})), 'r',
        substr({value}, div2({value}) + 1)), (h, i) -> named_struct('l', h.r, 'r', {mixed}),
        h -> concat(h.l, h.r))""".replace(f"div2({value})", f"int(length({value}) / 2)")


def _hash(half: str) -> str:
    return "sha2(concat('{key}|{kind}|', i, '|', " + half + "), 512)"


def feistel_pair(a: str, b: str, size_a: int, size_b: int, kind: str, key: str, rounds: int = ROUNDS) -> str:
    """Permutation of the pairs (a, b) with a < size_a, b < size_b; gives struct<a, b> of bigint."""
    add = ("pmod({x} + bigint(conv(substr(" + _hash("string({y})") + ", 1, 12), 16, 10)), {n}L)")
    add = add.replace("{key}", _q(key)[1:-1]).replace("{kind}", kind)
    one, two = add, add
    na = one.replace("{x}", "h.a").replace("{y}", "h.b").replace("{n}", str(size_a))
    nb = two.replace("{x}", "h.b").replace("{y}", "h.a").replace("{n}", str(size_b))
    return f"""aggregate(sequence(1, {rounds}), named_struct('a', bigint({a}), 'b', bigint({b})), (h, i) ->
        if(i % 2 = 1, named_struct('a', {na}, 'b', h.b), named_struct('a', h.a, 'b', {nb})))"""


def _refill(template: str, digits: str) -> str:
    """``template`` with its digits replaced, in order, by those of ``digits``."""
    return f"""aggregate(sequence(1, length({template})), named_struct('n', 0, 't', ''), (f, p) ->
        if(substr({template}, p, 1) between '0' and '9',
           named_struct('n', f.n + 1, 't', concat(f.t, substr({digits}, f.n + 1, 1))),
           named_struct('n', f.n, 't', concat(f.t, substr({template}, p, 1)))), f -> f.t)"""


def _respace(template: str, text: str) -> str:
    """``text`` with spaces where ``template`` has them."""
    return f"""aggregate(sequence(1, length({template})), named_struct('n', 0, 't', ''), (f, p) ->
        if(substr({template}, p, 1) = ' ', named_struct('n', f.n, 't', concat(f.t, ' ')),
           named_struct('n', f.n + 1, 't', concat(f.t, substr({text}, f.n + 1, 1)))), f -> f.t)"""


def valid_card(m: str) -> str:
    """SQL: the digits of ``m`` have a right check digit and are not all the same."""
    return _let(f"regexp_replace({m}, '[^0-9]', '')", "n", f"{luhn_sum('n', 0)} % 10 = 0 and n not rlike '^(.)\\\\1*$'")


def _mod97(text: str) -> str:
    """SQL: the digits and capitals of ``text``, letters as 10 to 35, as one number modulo 97."""
    return f"""aggregate(sequence(1, length({text})), 0, (s, j) -> {_let(f'ascii(substr({text}, j, 1))', 'c',
        'if(c < 58, (s * 10 + c - 48) % 97, (s * 100 + c - 55) % 97)')})"""


def valid_iban(m: str) -> str:
    """SQL: the check digits of ``m`` are right and in the range that the standard gives them."""
    return _let(f"replace({m}, ' ', '')", "n", f"int(substr(n, 3, 2)) between 2 and 98 and length(n) between 15 and 34 and "
                + _let("concat(substr(n, 5), left(n, 4))", "t", f"{_mod97('t')} = 1"))


def _full(m: str, p: str) -> str:
    return f"{m} rlike {_q('^(?:' + p + ')$')}"


def _day(m: str) -> str:
    return f"try_to_date(regexp_replace({m}, '/', '.'), 'd.M.yyyy')"


def _named_day(m: str) -> str:
    return f"if({m} rlike '^[0-9]', try_to_date({m}, 'd MMMM yyyy'), try_to_date({m}, 'MMMM d, yyyy'))"


def kind(m: str, kinds: tuple[str, ...]) -> str:
    """SQL for the kind of the found value ``m``, one of ``kinds``; null if it does not validate."""
    cases = (
        ("email", f"locate('@', {m}) > 0 and {_full(m, EMAIL)}"),
        ("ip", _full(m, IPV4)),
        ("date", f"{_full(m, ISO_DATE)} and try_to_date({m}, 'yyyy-MM-dd') is not null"),
        ("date", f"{_full(m, DMY_DATE)} and {_day(m)} is not null"),
        ("date", f"{_full(m, YMD_DATE)} and try_to_date({m}, 'yyyy/MM/dd') is not null"),
        ("date", f"({_full(m, DAY_MONTH)} or {_full(m, MONTH_DAY)}) and {_named_day(m)} is not null"),
        ("iban", f"{_full(m, IBAN)} and {valid_iban(m)}"),
        ("card", f"{_full(m, CARD)} and {valid_card(m)}"),
        ("ssn", _full(m, SSN)),
        ("phone", f"{_full(m, PHONE)} and length(regexp_replace({m}, '[^0-9]', '')) between 9 and 15"),
        ("secret", _full(m, SECRET)),
    )
    return f"case {' '.join(f"when {cond} then '{k}'" for k, cond in cases if k in kinds)} end"


def pseudonym(k: str, m: str, key: str) -> str:
    """SQL for the pseudonym of the value ``m`` of the kind ``k``."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    email = f"concat({feistel_text('v', 'email', key)}, substr({m}, locate('@', {m})))"
    email = _let(f"left({m}, locate('@', {m}) - 1)", "v", email)
    octets = f"split({m}, '[.]')"
    # first octets numbered without gaps: 222 of hosts, 34 reserved
    first = "int(o[0])"
    pair = "{} * 256 + int(o[1])".format
    host = _let(feistel_pair(pair(f"({first} - if({first} > 127, 2, 1))"), "int(o[2]) * 256 + int(o[3])", 222 * 256, 65536, "ip", key),
                "v", "concat_ws('.', v.a div 256 + if(v.a div 256 < 126, 1, 2), v.a % 256, v.b div 256, v.b % 256)")
    reserved = _let(feistel_pair(pair(f"case {first} when 0 then 0 when 127 then 1 else {first} - 222 end"), "int(o[2]) * 256 + int(o[3])",
                                 34 * 256, 65536, "ip", key),
                    "v", "concat_ws('.', case v.a div 256 when 0 then 0 when 1 then 127 else v.a div 256 + 222 end, v.a % 256, v.b div 256, v.b % 256)")
    ip = _let(octets, "o", f"if({first} in (0, 127) or {first} > 223, {reserved}, {host})")

    def date(days: str, out: str) -> str:
        a, b = DAYS
        return _let(days, "d", _let(feistel_pair(f"d div {b}", f"d % {b}", a, b, "date", key), "v",
                    _let(f"date_add(DATE'1900-01-01', int(v.a * {b} + v.b))", "t", out)))

    iso = date(f"datediff(to_date({m}), DATE'1900-01-01')", "date_format(t, 'yyyy-MM-dd')")
    sep = f"if(locate('/', {m}) > 0, '/', '.')"
    # day and month keep or lose their leading zero as in the original
    dmy = date(f"datediff({_day(m)}, DATE'1900-01-01')",
               f"concat(if({m} rlike '^0?[0-9][./]' and {m} not rlike '^0', day(t), date_format(t, 'dd')), {sep}, "
               f"if({m} rlike '^[0-9]+[./][1-9][./]', month(t), date_format(t, 'MM')), {sep}, date_format(t, 'yyyy'))")
    ymd = date(f"datediff(try_to_date({m}, 'yyyy/MM/dd'), DATE'1900-01-01')", "date_format(t, 'yyyy/MM/dd')")
    # the day keeps its leading zero or none where it has one digit
    number = f"if({m} rlike '(^| )[1-9][ ,]', string(day(t)), date_format(t, 'dd'))"
    named = date(f"datediff({_named_day(m)}, DATE'1900-01-01')",
                 f"if({m} rlike '^[0-9]', concat({number}, date_format(t, ' MMMM yyyy')), concat(date_format(t, 'MMMM '), {number}, date_format(t, ', yyyy')))")
    iban = _let(f"replace({m}, ' ', '')", "n", _let("substr(n, 5)", "v", _let(feistel_text("v", "iban", key), "w", _let(
        _let("concat(w, left(n, 2), '00')", "t", f"98 - {_mod97('t')}"), "c",
        _let("concat(left(n, 2), lpad(string(c), 2, '0'), w)", "z", _respace(m, "z"))))))
    body = "substr(n, 2, length(n) - 2)"
    card = _let(digits, "n", _let(f"concat(left(n, 1), {_let(body, 'v', feistel_text('v', 'card', key))})", "w",
                _let(f"concat(w, (10 - {luhn_sum('w', 1)} % 10) % 10)", "z", _refill(m, "z"))))
    # a country code in front stays
    code = f"regexp_extract({m}, '^\\\\+[0-9]{{1,3}}(?=[ .(-])', 0)"
    phone = _let(code, "k", _let(f"substr({m}, length(k) + 1)", "y", _let("regexp_replace(y, '[^0-9]', '')", "v", _let(
        feistel_text("v", "phone", key), "z", f"concat(k, {_refill('y', 'z')})"))))
    # areas 001 to 899 without 666; groups 01 to 99 with serials 0001 to 9999
    area = "int(left(v, 3)) - if(left(v, 3) > '666', 2, 1)"
    ssn = _let(digits, "v", _let(feistel_pair(area, "(int(substr(v, 4, 2)) - 1) * 9999 + int(substr(v, 6)) - 1", 898, 99 * 9999, "ssn", key), "p", _let(
        "concat(lpad(string(p.a + if(p.a < 665, 1, 2)), 3, '0'), lpad(string(p.b div 9999 + 1), 2, '0'), lpad(string(p.b % 9999 + 1), 4, '0'))",
        "z", _refill(m, "z"))))
    name = f"regexp_extract({m}, {_q(SECRET_NAME)}, 0)"
    secret = _let(name, "k", f"concat(k, {_let(f'substr({m}, length(k) + 1)', 'v', feistel_text('v', 'secret', key))})")
    new = {"email": email, "ip": ip, "iban": iban,
           "date": f"case when {_full(m, ISO_DATE)} then {iso} when {_full(m, YMD_DATE)} then {ymd} when {m} rlike '[A-Z]' then {named} else {dmy} end", "card": card, "ssn": ssn, "phone": phone, "secret": secret}
    return f"case {k} {' '.join(f"when '{x}' then {v}" for x, v in new.items())} else {m} end"


PART = "named_struct('kind', {}, 'text', {})".format
NONE = "string(null)"


def _cut(parts: str, pattern: str, kind_of) -> str:
    """SQL for the parts (array<struct<kind, text>>) with those that have no kind yet cut at ``pattern``;
    ``kind_of`` gives the kind of a match."""
    found = _let(f"regexp_extract_all(x.text, {_q(pattern)}, 0)", "f", f'''flatten(transform(split(x.text, {_q(pattern)}, -1),
        (g, i) -> if(i < size(f), array({PART(NONE, 'g')}, {PART(kind_of('f[i]'), 'f[i]')}), array({PART(NONE, 'g')}))))''')
    return f"flatten(transform({parts}, x -> if(x.kind is null and x.text rlike {_q(pattern)}, {found}, array(x))))"


def _picks(run: str) -> str:
    """SQL for the cards (first group, number of groups, text) of a run of digit groups ``w``: at each group the
    groupings are tried in order and the first that validates is a card; the scan goes on behind it, else at the next group."""
    tries = f"filter(transform(array({', '.join(_q(g) for g in GROUPINGS)}), p -> regexp_extract(r, p, 0)), c -> c <> '' and {valid_card('c')})"
    at = _let(f"array_join(slice({run}, i, {MOST_GROUPS + 1}), '')", "r", _let(f"try_element_at({tries}, 1)", "c",
              "named_struct('i', i, 'k', size(regexp_extract_all(c, '[0-9]+', 0)), 'c', c)"))
    return f"""aggregate(filter(transform(sequence(1, size({run})), i -> {at}), b -> b.c is not null),
        named_struct('next', 1, 'p', cast(array() as array<struct<i:int,k:int,c:string>>)),
        (s, b) -> if(b.i < s.next, s, named_struct('next', b.i + b.k, 'p', concat(s.p, array(b)))), s -> s.p)"""


def _apart(parts: str) -> str:
    """SQL for the parts with each run (kind, text, w, p) cut at its cards ``p``."""
    joined = "array_join(slice(x.w, {}, {}), '')".format
    behind = "if(j = 0, 1, x.p[j - 1].i + x.p[j - 1].k)"
    cut = f"""flatten(transform(sequence(0, size(x.p)), j -> if(j = size(x.p), array({PART(NONE, joined(behind, f'size(x.w) + 1 - {behind}'))}),
        array({PART(NONE, joined(behind, f'x.p[j].i - {behind}'))}, {PART("'card'", 'x.p[j].c')},
              {PART(NONE, f"substr({joined('x.p[j].i', 'x.p[j].k')}, length(x.p[j].c) + 1)")}))))"""
    return f"flatten(transform({parts}, x -> if(x.kind = 'run', {cut}, array({PART('x.kind', 'x.text')}))))"


def find(docs: DataFrame, text_col: str, parts: str) -> DataFrame:
    """``docs`` with the column ``parts``, array<struct<kind, text>>: the text in order, cut at its values, which have a kind.

    Values with clear borders are cut out first, then the cards among the digits left, by their
    groupings and then by all digits that stand together, and last what is left of phones and social
    security numbers.  What does not validate is looked at again by the later steps.
    """
    def one(*kinds):
        return lambda m: kind(m, kinds)

    # texts without a digit or @ pass at once
    steps = (f"if(`{text_col}` rlike '[0-9@=:]|AKIA', array({PART(NONE, f'`{text_col}`')}), cast(array() as array<struct<kind:string,text:string>>))",
             _cut(parts, CLEAR, one("email", "ip", "date", "iban", "ssn", "phone", "secret")),
             _cut(parts, RUN, lambda m: "'run'"),
             f"transform({parts}, x -> named_struct('kind', x.kind, 'text', x.text, 'w', if(x.kind = 'run', regexp_extract_all(x.text, '[+]?[0-9]+[^0-9+]*', 0), null)))",
             f"transform({parts}, x -> named_struct('kind', x.kind, 'text', x.text, 'w', x.w, 'p', if(x.kind = 'run', {_picks('x.w')}, null)))",
             _apart(parts),
             _cut(parts, WHOLE, one("card")),
             _cut(parts, LOOSE, one("ssn", "phone")))
    for step in steps:
        docs = docs.withColumn(parts, F.expr(step))
    return docs


def pseudonymise(docs: DataFrame, text_col: str = "text", *, key: str) -> DataFrame:
    """``key`` is the secret of the site: who has it can turn pseudonyms back.

    ``docs`` with the pseudonyms in the text, ``_pii_values`` (how many) and ``_pii_kinds`` (their kinds, sorted)."""
    # one evaluation per text: both results come from one struct
    tmp = fresh(docs, "_swapped")
    done = find(docs, text_col, tmp)
    done = done.withColumn(tmp, F.expr(f"transform({tmp}, x -> {PART('x.kind', pseudonym('x.kind', 'x.text', key))})"))
    done = done.withColumn(tmp, F.expr(f"""named_struct('text', if(size({tmp}) = 0, `{text_col}`, array_join(transform({tmp}, x -> x.text), '')),
        'kinds', filter(transform({tmp}, x -> x.kind), x -> x is not null))"""))
    cols = [F.col(f"{tmp}.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    kinds = F.coalesce(F.col(f"{tmp}.kinds"), F.array().cast("array<string>"))
    return done.select(*cols, F.size(kinds).alias(fresh(docs, "_pii_values")),
                       F.array_join(F.sort_array(F.array_distinct(kinds)), ",").alias(fresh(docs, "_pii_kinds")))
