"""Web addresses as the URL standard reads and writes them, as column expressions: nothing here leaves the JVM.

One pattern tells whether an address is written as the standard would write it; only others are taken apart, by a fold
over numbered steps (``_fold``): steps that follow one another lie side by side in the expression, not inside each other,
which keeps plans small and quick to analyse. The same text serves Spark SQL (``SQL_FUNCTIONS``). Hosts become
lower-case ASCII (punycode for other letters, wide forms and ideographic dots folded), numbers in any form become four
numbers, IPv6 addresses are shortened; backslashes count as slashes; default ports go; dot segments are resolved and each
part is percent-encoded by its own set. What isn't done: composing of decomposed letters in hosts, and checks of what
punycode labels stand for.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the URL standard: the characters that a part of an address may not hold as they are, and the default ports.
_NOT_ASCII = r"\x00-\x20\x7f-\x{10ffff}"
QUERY_SET = rf"[{_NOT_ASCII}\"#<>']"
PATH_SET = rf"[{_NOT_ASCII}\"#<>?^`{{}}]"
FRAGMENT_SET = rf"[{_NOT_ASCII}\"<>`]"
USER_SET = rf"[{_NOT_ASCII}\"#<>?^`{{}}/:;=@\[\]\\|]"
NO_HOST = r"[\x00-\x20\x7f#/:<>?@\[\\\]^|%]"
PORTS = {"http": "80", "https": "443"}
# Fixed values of punycode.
BASE, T_MIN, T_MAX, SKEW, DAMP, BIAS, FIRST = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Wide forms of ASCII, the capital sharp s and ideographic full stops, with what they stand for; characters that are left out of hosts.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "ẞ。｡"
_NARROW = "".join(map(chr, range(0x21, 0x7F))).lower() + "ß.."
_SILENT = "­͏​⁠﻿"

_PLAIN_HOST = r"(?![^/?#]*xn--)(?:[a-z0-9_](?:[a-z0-9_-]*[a-z0-9_])?\.)*[a-z](?:[a-z0-9_-]*[a-z0-9_])?"
PLAIN_HOST = rf"^{_PLAIN_HOST}$"
PLAIN = (
    rf"^https?://{_PLAIN_HOST}(?=/)(?![^?#]*/(?:\.|%2[eE]){{1,2}}(?:[/?#]|$))[!$%&'()*+,\-./0-9:;=@A-Z\[\]_a-z|~]*"
    r"(?:\?[!$%&()*+,\-./0-9:;=?@A-Z\[\\\]^_`a-z{|}~]*)?(?:#[!#$%&'()*+,\-./0-9:;=?@A-Z\[\\\]^_a-z{|}~]*)?$"
)
#: Scheme, authority, the rest; any number of slashes of either kind may follow the colon.
_PARTS = r"(?is)^(https?):[/\\]*([^/\\?#]*)(.*)$"


def let(value: Column, use, *more: Column) -> Column:
    """``use`` of values that are computed once each, however often ``use`` names them. It must name nothing else of a row."""
    if not more:
        return F.get(F.transform(F.array(value), use), F.lit(0))
    row = F.struct(*[v.alias(f"v{k}") for k, v in enumerate((value, *more))])
    return F.get(F.transform(F.array(row), lambda s: use(*[s[f"v{k}"] for k in range(len(more) + 1)])), F.lit(0))


def _q(s: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _fold(fields: dict[str, str], steps: list[dict[str, str]], result: str, s: str = "s", k: str = "k") -> str:
    """``fields`` (name: first value) taken through ``steps``; each tells which fields change to what, naming the others s.<field>."""
    row = lambda changed: "named_struct(" + ", ".join(f"'{f}', {changed.get(f, f'{s}.{f}')}" for f in fields) + ")"
    cases = " ".join(f"WHEN {at} THEN {row(step)}" for at, step in enumerate(steps, 1))
    return f"aggregate(sequence(1, {len(steps)}), {row(fields)}, ({s}, {k}) -> CASE {k} {cases} END, {s} -> {result})"


TEXT, TEXTS, NUMBERS = "cast(NULL AS string)", "cast(NULL AS array<string>)", "cast(NULL AS array<bigint>)"
_CHARS = "'(?s)(.)'"


def _encoded(s: str, characters: str) -> str:
    """A text with the UTF-8 octets of some characters (a pattern of one of them) as %XX."""
    octets = f"CASE WHEN c RLIKE {_q(characters)} THEN regexp_replace(hex(c), '(..)', '%$1') ELSE c END"
    return f"CASE WHEN {s} RLIKE {_q(characters)} THEN array_join(transform(regexp_extract_all({s}, {_CHARS}, 1), c -> {octets}), '') ELSE {s} END"


def _without_dots(p: str) -> str:
    """A path whose dot segments are resolved; it ends with a slash where they stand last."""
    one, two = _q(r"^(?:\.|%2[eE])$"), _q(r"^(?:\.|%2[eE]){2}$")
    put = f"CASE WHEN x RLIKE {two} THEN slice(a, 1, greatest(1, size(a) - 1)) WHEN x RLIKE {one} THEN a ELSE array_append(a, x) END"
    kept = f"array_join(aggregate(slice(split({p}, '/'), 2, size(split({p}, '/'))), array(''), (a, x) -> {put}), '/')"
    closing = f"CASE WHEN {p} RLIKE {_q(r'/(?:\.|%2[eE]){1,2}$')} THEN '/' ELSE '' END"
    return f"CASE WHEN {p} RLIKE {_q(r'/(?:\.|%2[eE]){1,2}(?:/|$)')} THEN regexp_replace('/' || {kept} || {closing}, '^//', '/') ELSE {p} END"


def _punycode(label: str) -> str:
    """A label in ASCII: as it is, or 'xn--' and its punycode.

    The code points beyond ASCII are put in one after the other, smallest first; what is written is how far the next place
    lies in the order of all (code point, place). One code point takes 16 steps: the distance, nine digits, the new bias.
    """
    fields = {"chars": TEXTS, "pts": "cast(NULL AS array<struct<cp: bigint, before: bigint>>)", "out": TEXT, "n": f"{FIRST}L", "i": "0L", "h": "0L", "bias": f"{BIAS}L", "q": "0L", "d": "0L", "b": "0L", "first": "true"}
    row = lambda **changed: "named_struct(" + ", ".join(f"'{f}', {changed.get(f, f'p.{f}')}" for f in fields) + ")"
    start = "named_struct(" + ", ".join(f"'{f}', {v}" for f, v in fields.items()) + ")"
    point = "p.pts[(k - 3) div 16]"
    before = "cast(size(filter(p.chars, (e, g) -> g < f AND ascii(e) <= ascii(c))) AS bigint)"
    points = f"array_sort(filter(transform(p.chars, (c, f) -> named_struct('cp', cast(ascii(c) AS bigint), 'before', {before})), x -> x.cp >= {FIRST}))"
    plain = f"filter(p.chars, c -> ascii(c) < {FIRST})"
    t = f"greatest({T_MIN}L, least({T_MAX}L, (k - 3) % 16 * {BASE} - p.bias))"
    digit = lambda n: f"substr('{DIGITS}', cast({n} AS int) + 1, 1)"
    more = row(out=f"p.out || {digit(f'({t} + (p.q - {t}) % ({BASE} - {t}))')}", q=f"(p.q - {t}) div ({BASE} - {t})")
    start_d = f"CASE WHEN p.first THEN p.d div {DAMP} ELSE p.d div 2 END"
    delta = f"({point}.cp - p.n) * (p.h + 1) + {point}.before - p.i"
    step = f"""CASE WHEN k = 1 THEN {row(chars=f"regexp_extract_all({label}, {_CHARS}, 1)")}
      WHEN k = 2 THEN {row(pts=points, h=f"cast(size({plain}) AS bigint)", out=f"array_join({plain}, '') || CASE WHEN size({plain}) > 0 THEN '-' ELSE '' END")}
      WHEN (k - 3) div 16 >= size(p.pts) THEN p
      WHEN (k - 3) % 16 = 0 THEN {row(q=delta, d=delta, b="0L")}
      WHEN (k - 3) % 16 < 10 THEN CASE WHEN p.q < 0 THEN p WHEN p.q >= {t} THEN {more} ELSE {row(out=f"p.out || {digit('p.q')}", q="-1L")} END
      WHEN (k - 3) % 16 = 10 THEN {row(d=f"({start_d}) + ({start_d}) div (p.h + 1)")}
      WHEN (k - 3) % 16 < 15 THEN CASE WHEN p.d > {(BASE - T_MIN) * T_MAX // 2} THEN {row(d=f"p.d div {BASE - T_MIN}", b=f"p.b + {BASE}")} ELSE p END
      ELSE {row(bias=f"p.b + {BASE - T_MIN + 1} * p.d div (p.d + {SKEW})", n=f"{point}.cp", i=f"{point}.before + 1", h="p.h + 1", first="false")} END"""
    return f"CASE WHEN {label} RLIKE '^[\\\\x00-\\\\x7f]*$' THEN {label} ELSE aggregate(sequence(1, 2 + 16 * char_length({label})), {start}, (p, k) -> {step}, p -> 'xn--' || p.out) END"


def _number(x: str) -> str:
    """A part of an IPv4 address in decimal, octal or hexadecimal digits; null for anything else."""
    return f"try_cast(CASE WHEN {x} RLIKE '^0x[0-9a-f]{{1,15}}$' THEN conv(substr({x}, 3), 16, 10) WHEN {x} = '0x' THEN '0' WHEN {x} RLIKE '^0[0-7]{{1,20}}$' THEN conv({x}, 8, 10) WHEN {x} RLIKE '^(0|[1-9][0-9]{{0,15}})$' THEN {x} END AS bigint)"


def _ipv4(n: str) -> str:
    """One to four numbers as four octets; null if they are no address."""
    firsts, last = f"slice({n}, 1, size({n}) - 1)", f"element_at({n}, -1)"
    good = f"size({n}) <= 4 AND NOT exists({n}, x -> x IS NULL) AND NOT exists({firsts}, x -> x > 255) AND {last} < shiftleft(1L, 8 * (5 - size({n})))"
    whole = f"({last} + aggregate(transform({firsts}, (x, j) -> shiftleft(x, 24 - 8 * j)), 0L, (a, x) -> a + x))"
    return f"CASE WHEN {good} THEN concat_ws('.', " + ", ".join(f"cast({whole} div {256**j} % 256 AS string)" for j in (3, 2, 1, 0)) + ") END"


def _ipv6(host: str) -> str:
    """An address between brackets in its shortest form; null if it is none."""
    four = _q(r"^.*:((?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3})$")
    n = lambda j: f"cast(split(w.tail, '[.]')[{j}] AS int)"
    two = lambda j: f"lower(hex(cast({n(j)} * 256 + {n(j + 1)} AS bigint)))"
    side = lambda at: f"CASE WHEN coalesce(try_element_at(split(w.inner, '::'), {at}), '') = '' THEN cast(array() AS array<string>) ELSE split(try_element_at(split(w.inner, '::'), {at}), ':') END"
    whole = "CASE WHEN NOT contains(w.inner, '::') AND size(w.a) = 8 THEN w.a WHEN size(split(w.inner, '::')) = 2 AND size(w.a) + size(w.b) <= 7 THEN concat(w.a, array_repeat('0', 8 - size(w.a) - size(w.b)), w.b) END"
    zeros = lambda j: _q(rf"^(.*?)(?:^|:)0(?::0){{{j}}}(?::|$)")
    shorter = "CASE " + " ".join(f"WHEN w.inner RLIKE {zeros(j)} THEN regexp_replace(regexp_replace(w.inner, {zeros(j)}, '$1::'), '^:::', '::')" for j in range(7, 0, -1)) + " ELSE w.inner END"
    steps = [
        {"inner": f"lower(regexp_extract({host}, {_q(r'^\[(.*)\]$')}, 1))"},
        {"tail": f"regexp_extract(w.inner, {four}, 1)"},
        {"inner": f"CASE WHEN w.tail = '' THEN CASE WHEN NOT contains(w.inner, '.') THEN w.inner END WHEN {' AND '.join(f'{n(j)} <= 255' for j in range(4))} THEN substr(w.inner, 1, char_length(w.inner) - char_length(w.tail)) || {two(0)} || ':' || {two(2)} END"},
        {"a": side(1), "b": side(2)},
        {"a": whole},
        {"inner": "CASE WHEN NOT exists(w.a, x -> NOT x RLIKE '^[0-9a-f]{1,4}$') THEN array_join(transform(w.a, x -> regexp_replace(x, '^0+(?=.)', '')), ':') END"},
        {"inner": shorter},
    ]
    return _fold({"inner": TEXT, "tail": TEXT, "a": TEXTS, "b": TEXTS}, steps, "'[' || w.inner || ']'", "w", "j")


def _host_steps(host: str) -> list[dict[str, str]]:
    """Steps over the fields host and nums that make a host what the standard writes; null where it is none."""
    ascii_only = r"'^[\\x00-\\x7f]*$'"
    six = "startswith(s.host, '[')"
    labels = f"transform(split(lower(translate(lower(s.host), {_q(_WIDE + _SILENT)}, {_q(_NARROW)})), '[.]'), l -> {_punycode('l')})"
    return [
        {"host": host},
        {"host": "CASE WHEN contains(s.host, '%') THEN try_url_decode(replace(s.host, '+', '%2B')) ELSE s.host END"},
        {"host": f"CASE WHEN {six} THEN {_ipv6('s.host')} WHEN s.host RLIKE {ascii_only} THEN lower(s.host) ELSE array_join({labels}, '.') END"},
        {"host": f"CASE WHEN {six} OR (s.host <> '' AND NOT s.host RLIKE {_q(NO_HOST)}) THEN s.host END"},
        {"nums": f"CASE WHEN s.host RLIKE {_q(r'(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$')} THEN transform(split(regexp_replace(s.host, '[.]$', ''), '[.]'), x -> {_number('x')}) END"},
        {"host": f"CASE WHEN s.nums IS NULL THEN s.host ELSE {_ipv4('s.nums')} END"},
    ]


def _url_steps() -> tuple[dict[str, str], list[dict[str, str]], str]:
    part = lambda k: f"regexp_extract(s.v, {_q(_PARTS)}, {k})"
    shape = _q(r"^(\[[^\]]*\]|[^:\[]*)(?::([0-9]*))?$")
    named = "CASE WHEN s.user = '' THEN '' ELSE s.name || CASE WHEN s.word <> '' THEN ':' || s.word ELSE '' END || CASE WHEN s.name <> '' OR s.word <> '' THEN '@' ELSE '' END END"
    defaults = " ".join(f"WHEN s.scheme = '{scheme}' AND s.port = '{port}' THEN ''" for scheme, port in PORTS.items())
    before = [
        {"v": r"regexp_replace(u, '^[\\x00-\\x20]+|[\\x00-\\x20]+$|[\\t\\n\\r]', '')"},
        {"v": f"CASE WHEN s.v RLIKE {_q(_PARTS)} THEN s.v END"},
        {"scheme": f"lower({part(1)})", "place": part(2), "rest": part(3)},
        {"user": r"regexp_extract(s.place, '(?s)^(.*)@[^@]*$', 1)", "place": r"regexp_extract(s.place, '(?s)^(?:.*@)?([^@]*)$', 1)"},
        {"name": "regexp_extract(s.user, '(?s)^([^:]*)', 1)", "word": "regexp_extract(s.user, '(?s)^[^:]*:(.*)$', 1)", "port": f"regexp_replace(regexp_extract(s.place, {shape}, 2), '^0+(?=.)', '')"},
        {"name": _encoded("s.name", USER_SET), "word": _encoded("s.word", USER_SET), "port": f"CASE WHEN s.port = '' THEN '' {defaults} WHEN s.port RLIKE '^[0-9]{{1,5}}$' AND try_cast(s.port AS int) < 65536 THEN ':' || s.port END"},
        {"user": named, "path": r"regexp_replace(regexp_extract(s.rest, '(?s)^([^?#]*)', 1), '\\\\', '/')", "query": "regexp_extract(s.rest, '(?s)^[^?#]*([?][^#]*)', 1)", "mark": "CASE WHEN contains(s.rest, '#') THEN regexp_extract(s.rest, '(?s)^[^#]*(#.*)$', 1) ELSE '' END"},
        {"path": "CASE WHEN s.path = '' THEN '/' ELSE s.path END"},
        {"path": _without_dots("s.path")},
        {"path": _encoded("s.path", PATH_SET), "query": _encoded("s.query", QUERY_SET), "mark": _encoded("s.mark", FRAGMENT_SET)},
    ]
    steps = before + _host_steps(f"CASE WHEN s.place RLIKE {shape} THEN regexp_extract(s.place, {shape}, 1) END")
    fields = dict.fromkeys(("v", "scheme", "place", "rest", "user", "name", "word", "port", "path", "query", "mark", "host"), TEXT) | {"nums": NUMBERS}
    return fields, steps, "s.scheme || '://' || s.user || s.host || s.port || s.path || s.query || s.mark"


def _join_steps() -> tuple[dict[str, str], list[dict[str, str]], str]:
    """``r.raw`` against ``r.base``, which the standard has written: an address for the standard to write, or null."""
    head = "regexp_extract(s.v, '(?s)^[^?#]*', 0)"
    unusable = r"(s.v = '' OR startswith(s.v, '#') OR (s.v RLIKE '^[A-Za-z][A-Za-z0-9+.-]*:' AND NOT s.v RLIKE '(?i)^https?:') OR r.base IS NULL)"
    own = "(s.v RLIKE '(?i)^https?:(?!//)' AND lower(regexp_extract(s.v, '^([A-Za-z]*):', 1)) = s.scheme)"  # adds nothing to the base
    steps = [
        {"v": r"regexp_replace(r.raw, '^[\\x00-\\x20]+|[\\x00-\\x20]+$|[\\t\\n\\r]', '')", "scheme": "regexp_extract(r.base, '^([a-z]+):', 1)"},
        {"v": rf"CASE WHEN contains(s.v, '\\') THEN replace({head}, '\\', '/') || regexp_extract(s.v, '(?s)^[^?#]*(.*)$', 1) ELSE s.v END"},
        {"v": f"CASE WHEN {unusable} THEN NULL WHEN {own} THEN regexp_replace(s.v, '^[A-Za-z]*:', '') ELSE s.v END"},
        {"v": "CASE WHEN s.v RLIKE '(?i)^https?:' THEN s.v WHEN startswith(s.v, '//') THEN s.scheme || ':' || s.v WHEN startswith(s.v, '/') THEN regexp_extract(r.base, '^[a-z]+://[^/]*', 0) || s.v"
              " WHEN startswith(s.v, '?') THEN regexp_extract(r.base, '^[^?#]*', 0) || s.v WHEN s.v RLIKE '^(?:#|$)' THEN regexp_extract(r.base, '^[^#]*', 0) || s.v ELSE regexp_extract(r.base, '^([^?#]*/)', 1) || s.v END"},
    ]
    return {"v": TEXT, "scheme": TEXT}, steps, "s.v"


#: Bodies of one argument each, as Spark SQL.
STANDARD = f"CASE WHEN u RLIKE {_q(PLAIN)} THEN u ELSE {_fold(*_url_steps())} END"
HOST = f"CASE WHEN h RLIKE {_q(PLAIN_HOST)} THEN h ELSE {_fold({'host': TEXT, 'nums': NUMBERS}, _host_steps('h'), 's.host')} END"
JOIN = _fold(*_join_steps())


def _applied(argument: Column, name: str, body: str) -> Column:
    """``body`` with ``name`` for the argument; a lambda function in text takes one call to make, however long it is."""
    return F.get(F.call_function("transform", F.array(argument), F.expr(f"{name} -> {body}")), F.lit(0))


def url_standard(u: Column) -> Column:
    """An http or https address as the URL standard writes it; null for what it doesn't read as one."""
    return _applied(u, "u", STANDARD)


def host_standard(h: Column) -> Column:
    """A host as the URL standard writes it; null where it is none."""
    return _applied(h, "h", HOST)


def joined(raw: Column, base: Column) -> Column:
    """``raw`` against an address in the standard's form, in any form; null for fragments, other schemes and without a base."""
    return _applied(F.struct(raw.alias("raw"), base.alias("base")), "r", JOIN)


def punycode(label: Column) -> Column:
    return _applied(label, "l", _punycode("l"))


def ipv6(host: Column) -> Column:
    return _applied(host, "h", _ipv6("h"))
