"""The leading ``---`` property block of a note, as built-in expressions.

A block is cut into the entries of its outer map (``key: value`` lines, or one flow map), and
the lines of each entry go through one fold with a stack of indentations: lists and maps of any
depth, also ``- - x`` and ``- key: x``; flow lists and maps, plain and quoted text over several
lines; ``|`` and ``>`` text; anchors and aliases.  An entry that can't be read (a key given twice,
tags, merge keys, complex keys) is left out by itself and flagged by
:func:`frontmatter_error`, so one odd entry never hides a note's tags.

Scalars are those of YAML 1.1: numbers with signs, underscores, exponents, base 2, 8, 16 and 60,
``.inf`` and ``.nan``, booleans, nulls, dates and times.

A parsed block is an array of ``struct<k, y, j>`` in source order: the key, the
value as YAML flow text, and the value as JSON text.  ``y`` and ``j`` differ
only where JSON has no such value: dates are quoted and infinite numbers null.
Keeping both lets tag rules tell a date from a string.
"""

from __future__ import annotations

import json
from functools import wraps
from weakref import WeakKeyDictionary

from pyspark.sql import Column, SparkSession, functions as F

from .text import WS, let, trim_ws

BLOCK = r"\A\ufeff?---[ \t]*\r?\n((?s:.*?\n)?)---[ \t]*(?:\r?\n|\z)"
OPENING = r"\A\ufeff?---[ \t]*\r?\n"
NEXT_ENTRY = r"\r?\n(?=[^\s\]}-])"
# A key and what follows it on its line.
_KEY_TEXT = r"""\"(?:[^\"\\]|\\.)*+\"|'(?:[^']|'')*+'|[^\s\"'\[\]{}#&*!|>%@`,?:-][^:\r\n]*?|-[^\s:]+"""
KEY_LINE = rf"\A({_KEY_TEXT})[ \t]*:(?:[ \t]+(.*))?\z"
ROOT_MAP = r"\A\{(?s:.*)\}\z"
# The parts of a nested flow collection: quoted text, brackets, commas, colons, plain text.
FLOW_TOKEN = (
    r"""("(?:[^"\\]|\\(?s:.))*+"|'(?:[^']|'')*+'|[\[\]{},]|(?<=["']):|:(?=[\s\[\]{},]|\z)"""
    r"""|[^\s\[\]{},:"'](?:[^\[\]{},:]|:(?![\s\[\]{},]|\z))*+)"""
)
FLOW_QUOTED = r"""(?<![^\s\[{,:])(?:"(?:[^"\\]|\\(?s:.))*+"|'(?:[^']|'')*+')"""

NULLS = ("", "~", "null", "Null", "NULL")
TRUES = ("true", "True", "TRUE")
FALSES = ("false", "False", "FALSE")
INTEGER = r"\A[-+]?(?:0|[1-9][0-9]*)\z"
BASED = r"\A[-+]?0(?:b[01_]+|x[0-9a-fA-F_]+|[0-7_]+)(?<!_)\z"
SEXAGESIMAL = r"\A[-+]?[0-9][0-9_]*(?::[0-5]?[0-9])+(?:\.[0-9_]*)?(?<!_)\z"
FLOAT = r"\A(?:[-+]?(?:0|[1-9][0-9_]*)(?:\.[0-9_]*)?(?:[eE][-+]?[0-9]+)?|\.[0-9_]+(?:[eE][-+]?[0-9]+)?)(?<!_)\z"
ENDLESS = r"\A(?:[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))\z"
DATE = r"\A\d{4}-\d{2}-\d{2}\z"
TIME = r"\A\d{4}-\d\d?-\d\d?(?:[Tt]|[ \t]+)\d\d?:\d{2}:\d{2}(?:\.\d*)?(?:[ \t]*(?:Z|[-+]\d\d?(?::\d\d)?))?\z"
DOUBLE_QUOTED = r"""\A"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*+"\z"""
SINGLE_QUOTED = r"\A'(?:[^'\r]|'')*+'\z"
# A plain scalar: no indicator in front, no ": " inside.
PLAIN = r"\A(?![\[\]{}&*!|>%@`,\"'#])(?![-?:](?:\s|\z))(?:[^:\r]|:(?!\s|\z))*+\z"
JSON_STRING = r'"(?:[^"\\]|\\.)*+"'

ENTRIES = "array<struct<k:string,y:string,j:string>>"

BLOCK_SCALAR = r"\A([|>])([-+]?)(\d?)([-+]?)[ \t]*(?:#[^\n]*)?(?:\n|\z)"
COMMENT = r"\A#"
ANCHOR = r"\A&([^\s\[\]{},]+)(?:\s+|\z)"
ALIAS = r"\A\*[^\s\[\]{},]+\z"
# Around the name of an alias until its anchor is looked up.
NAMED = "\ue000"
# The line after the last one of an entry.
END = "\u0000"
# Escapes of double-quoted text that JSON lacks, with their code points.
_ESCAPES = {"0": 0, "a": 7, "v": 11, "e": 27, " ": 32, "N": 0x85, "_": 0xA0, "L": 0x2028, "P": 0x2029}
# In front of the text of an entry that is carried over as it is.
RAW = "\u0000"

_built: WeakKeyDictionary[SparkSession, dict] = WeakKeyDictionary()


def _once(build):
    """Build the expression for a column *name* once per session.

    The parser is a few hundred expression nodes; a query that needs it several
    times would spend longer putting it together than running it.
    """

    @wraps(build)
    def column(content: Column | str) -> Column:
        if not isinstance(content, str):
            return build(content)
        known = _built.setdefault(SparkSession.active(), {})
        key = (build.__name__, content)
        if key not in known:
            known[key] = build(content)
        return known[key]

    return column


def _col(content: Column | str) -> Column:
    return F.col(content) if isinstance(content, str) else content


def json_string(c: Column) -> Column:
    """``c`` as a JSON string literal."""
    text = F.to_json(F.array(c))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def json_inner(c: Column) -> Column:
    """``c`` as it stands inside a JSON string literal."""
    text = F.to_json(F.array(c))
    return F.substring(text, F.lit(3), F.length(text) - 4)


def _number(v: Column) -> Column:
    """A float as the shortest plain digits, or with an exponent when it is very large or small."""

    def written(x: Column) -> Column:
        plain = F.regexp_replace(x.cast("decimal(38,16)").cast("string"), r"\.?0+\z", "")
        exponent = F.regexp_replace(F.regexp_replace(x.cast("string"), r"(?:\.0)?E(?=\d)", "e+"), r"(?:\.0)?E-", "e-")
        size = F.abs(x)
        return F.when(size == 0, "0").when((size >= 1e-6) & (size < 1e21), plain).otherwise(exponent)

    return let(v.cast("double"), written)


def _based(v: Column) -> Column:
    """Digits of base 2, 8 or 16, or parts of 60, in base 10."""
    sign = F.when(F.startswith(v, F.lit("-")), "-").otherwise("")

    def sixty(n: Column) -> Column:
        parts = F.transform(F.split(n, ":"), lambda p: p.cast("double"))
        return _number(F.aggregate(parts, F.lit(0.0), lambda total, p: total * 60 + p))

    def digits(n: Column) -> Column:
        return (
            F.when(F.contains(n, F.lit(":")), sixty(n))
            .when(F.startswith(n, F.lit("0b")), F.conv(F.substring(n, 3, 64), 2, 10))
            .when(F.startswith(n, F.lit("0x")), F.conv(F.substring(n, 3, 64), 16, 10))
            .otherwise(F.conv(n, 8, 10))
        )

    return let(F.concat(sign, let(F.regexp_replace(v, r"\A[-+]|_", ""), digits)), lambda n: F.when(n == "-0", "0").otherwise(n))


def _scalar(raw: Column) -> Column:
    """YAML flow text of one scalar, or null when it is not a known scalar."""

    def time(v: Column) -> Column:
        zone = F.regexp_extract(v, r"(?:Z|[-+]\d\d?(?::\d\d)?)\z", 0)
        padded = F.regexp_replace(F.regexp_replace(zone, r"\A([-+])(\d)(?!\d)", r"$1\0$2"), r"\A([-+]\d\d)\z", "$1:00")
        local = F.regexp_replace(F.regexp_extract(v, r"\A\d{4}-\d\d?-\d\d?[Tt \t]+\d\d?:\d{2}:\d{2}(?:\.\d*)?", 0), r"[Tt \t]+", " ")
        at = F.concat(F.regexp_replace(local, r"\.\z", ""), F.when(padded == "", "Z").otherwise(padded)).try_cast("timestamp")
        utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz"))
        return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

    def rule(v: Column) -> Column:
        single = F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit("''"), F.lit("'"))
        digit = F.rlike(v, F.lit(r"\A[-+]?\.?[0-9]"))
        numeric = (
            F.when(F.rlike(v, F.lit(INTEGER)), F.regexp_replace(v, r"\A\+|\A-(?=0\z)", ""))
            .when(F.rlike(v, F.lit(BASED)) | F.rlike(v, F.lit(SEXAGESIMAL)), _based(v))
            .when(F.rlike(v, F.lit(FLOAT)), _number(F.replace(v, F.lit("_"), F.lit(""))))
            .when(F.rlike(v, F.lit(DATE)), F.concat(v, F.lit("T00:00:00.000Z")))
            .when(F.rlike(v, F.lit(TIME)), time(v))
            .when(F.rlike(v, F.lit(PLAIN)), json_string(v))
        )
        return (
            F.when(digit, numeric)
            .when(v.isin(*NULLS), "null")
            .when(v.isin(*TRUES), "true")
            .when(v.isin(*FALSES), "false")
            .when(F.startswith(v, F.lit('"')), let(_escaped(v), lambda e: F.when(F.rlike(e, F.lit(DOUBLE_QUOTED)), e)))
            .when(F.rlike(v, F.lit(SINGLE_QUOTED)), json_string(single))
            .when(F.rlike(v, F.lit(ENDLESS)), F.lower(v))
            .when(F.rlike(v, F.lit(ALIAS)), F.concat(F.lit('"' + NAMED), F.substring(v, 2, 1 << 20), F.lit(NAMED + '"')))
            .when(F.rlike(v, F.lit(PLAIN)), json_string(v))
        )

    # A comment ends an unquoted value; text over several lines is folded.
    bare = F.when(F.rlike(raw, F.lit(r"\A\s*[\"']")), F.regexp_replace(raw, r"\s+#[^\"'\r\n]*\z", "")).otherwise(
        F.regexp_replace(raw, r"(?m)(?:^|[ \t]+)#[^\r\n]*$", "")
    )
    return let(_folded(trim_ws(bare)), rule)


def _escaped(v: Column) -> Column:
    """A double-quoted scalar with the escapes of JSON for those of YAML."""

    def part(t: Column) -> Column:
        code = F.try_element_at(F.from_json(F.lit(json.dumps({k: f"{v:08x}" for k, v in _ESCAPES.items()})), "map<string,string>"), F.substring(t, 2, 1))
        point = F.when(F.rlike(t, F.lit(r"\A\\[xU]")), F.lpad(F.substring(t, 3, 8), 8, "0")).when(F.startswith(t, F.lit("\\")), code)
        return F.when(t == "\t", "\\t").when(point.isNotNull(), json_inner(F.decode(F.unhex(point), "UTF-32"))).otherwise(t)

    parts = F.regexp_extract_all(v, F.lit(r"((?s:\\x[0-9a-fA-F]{2}|\\U[0-9a-fA-F]{8}|\\[^xU]|\t|[^\\\t]+|\\))"), 1)
    return F.when(F.rlike(v, F.lit(r"[\\\t]")), F.array_join(F.transform(parts, part), "")).otherwise(v)


def _folded(lines: Column) -> Column:
    """One line end becomes a space, more lose one; in double quotes those left are escaped."""
    many = F.contains(lines, F.lit("\n"))
    continued = F.when(F.startswith(lines, F.lit('"')), F.regexp_replace(lines, r"(?<!\\)((?:\\\\)*)\\\n[ \t]*", "$1")).otherwise(lines)
    joined = F.regexp_replace(F.regexp_replace(continued, r"(?<!\n)[ \t]*\n[ \t]*(?!\s*\n)(?=\S)", " "), r"\n(\n+)", "$1")
    escaped = F.when(F.startswith(lines, F.lit('"')), F.replace(joined, F.lit("\n"), F.lit("\\n"))).otherwise(joined)
    return F.when(many, escaped).otherwise(lines)


def _part(ts: Column, t: Column, i: Column) -> Column:
    """Flow text of one part of a flow collection, or of a scalar that stands alone."""
    following = F.get(ts, i + 1)
    return (
        F.when(t == ",", F.when(following.isin("]", "}"), "").otherwise(t))
        .when(F.rlike(t, F.lit(r"\A[\[\]{}:]\z")), t)
        .when((following == ":") & ~F.rlike(t, F.lit(r"\A[\"']")), json_string(trim_ws(t)))
        .otherwise(_scalar(t))
    )


def _unindented(body: Column) -> Column:
    """Lines without the indentation of the first one that has text."""
    indent = F.regexp_extract(body, r"\A(?:[ \t]*\n)*([ \t]+)", 1)
    return F.regexp_replace(body, F.concat(F.lit("(?m)^"), indent), F.lit(""))


def _block_scalar(v: Column) -> Column:
    """The text of a ``|`` or ``>`` scalar as a JSON string."""
    body = F.regexp_replace(v, r"\A[^\n]*\n?", "")
    given = F.regexp_extract(v, BLOCK_SCALAR, 3)
    fixed = F.regexp_replace(body, F.concat(F.lit("(?m)^[ ]{1,"), given, F.lit("}")), F.lit(""))
    lines = F.when(given == "", _unindented(body)).otherwise(fixed)
    # Folding joins neighbouring lines with text at their start; a blank line becomes one line end.
    folded = F.regexp_replace(F.regexp_replace(lines, r"(?<=[^\n])\n(?=[^\s])", " "), r"\n(\n+)(?=[^\s])", "$1")
    text = F.when(F.startswith(v, F.lit(">")), folded).otherwise(lines)
    chomp = F.concat(F.regexp_extract(v, BLOCK_SCALAR, 2), F.regexp_extract(v, BLOCK_SCALAR, 4))
    kept = F.regexp_replace(text, r"\s+\z", "")
    ended = F.when(chomp == "+", F.concat(text, F.lit("\n"))).when((chomp == "-") | (kept == ""), kept).otherwise(F.concat(kept, F.lit("\n")))
    return json_string(ended)


def _is_open_flow(v: Column) -> Column:
    """Brackets that text starts with are not all closed."""

    def count(t: Column, sides: str) -> Column:
        return F.length(F.regexp_replace(t, f"[^{sides}]", ""))

    plain = F.regexp_replace(v, FLOW_QUOTED, "")
    unclosed_ = let(plain, lambda t: count(t, r"\[{") > count(t, r"\]}"))
    return F.rlike(v, F.lit(r"\A[\[{]")) & unclosed_


UNCLOSED_QUOTE = r"""\A(?:"(?:[^"\\]|\\(?s:.))*+|'(?:[^']|'')*+)\z"""


def _rendered(buf: Column) -> Column:
    """Flow text of a collected value: block text, a flow collection or a scalar."""

    def read(v: Column) -> Column:
        is_flow = F.rlike(v, F.lit(r"\A[\[{]"))
        flow = F.regexp_replace(v, r"(?m)(?:^|[ \t]+)#[^\"'\]}\n]*$", "")
        parts = F.when(is_flow, F.regexp_extract_all(flow, F.lit(FLOW_TOKEN), 1)).otherwise(F.array(v))

        def joined(ts: Column) -> Column:
            # Nothing but white space lies between the parts.
            whole = ~is_flow | (F.regexp_replace(F.array_join(ts, ""), r"\s", "") == F.regexp_replace(flow, r"\s", ""))
            return let(
                F.transform(ts, lambda t, i: _part(ts, t, i)),
                lambda ys: F.when(whole & ~F.exists(ys, lambda y: y.isNull()), F.array_join(ys, "")),
            )

        return F.when(F.rlike(v, F.lit(BLOCK_SCALAR)), _block_scalar(v)).otherwise(let(parts, joined))

    return let(F.regexp_replace(buf, ANCHOR, ""), read)


_LEVEL = "struct<c:int,k:string>"
_LEVELS = f"array<{_LEVEL}>"
_ANCHORS = "array<struct<n:string,y:string>>"
# The flow text so far, open collections by column, whether and below which column a value has to come, a
# value being collected and the column its further lines lie behind, anchored values, and if it failed.
_FOLD = f"struct<y:string,stack:{_LEVELS},want:boolean,wc:int,buf:string,bc:int,anchors:{_ANCHORS},bad:boolean>"


def _level(c: Column, k: str) -> Column:
    return F.struct(c.alias("c"), F.lit(k).alias("k"))


def _fold_line(s: Column, line: Column) -> Column:
    """One line of an entry: more of the value being collected, or its end and the line's own structure."""

    def state(y, stack, want, wc, buf, bc, anchors, bad) -> Column:
        values = (y, stack, want, wc, buf, bc, anchors, bad)
        names = ("y", "stack", "want", "wc", "buf", "bc", "anchors", "bad")
        return F.struct(*(v.alias(n) for v, n in zip(values, names, strict=True)))

    def of(x: Column) -> Column:
        indent, text = x["indent"], x["text"]
        buf = s["buf"]
        held = F.regexp_replace(buf, ANCHOR, "")
        is_block = F.rlike(held, F.lit(BLOCK_SCALAR))
        is_open = F.rlike(held, F.lit(UNCLOSED_QUOTE)) | _is_open_flow(held)
        blank, end = text == "", line == END
        comment = F.rlike(text, F.lit(COMMENT))
        goes_on = ~end & F.coalesce(F.when(blank | is_block & (indent > s["bc"]), True).otherwise(~is_block & (is_open | ~comment & (indent > s["bc"]))), F.lit(False))
        longer = F.concat(buf, F.lit("\n"), F.when(is_block, line).otherwise(text))
        collected = state(s["y"], s["stack"], s["want"], s["wc"], longer, s["bc"], s["anchors"], s["bad"])
        return (
            F.when(goes_on, collected)
            .when(~end & (blank | comment), s)
            .otherwise(let(F.when(buf.isNotNull(), _rendered(buf)), lambda value: F.when(end, ended(value)).otherwise(structure(x, value))))
        )

    def closed(levels: Column) -> Column:
        return F.array_join(F.transform(F.reverse(levels), lambda o: F.when(o["k"] == "s", "]").otherwise("}")), "")

    def noted(value: Column) -> Column:
        """The anchors, with that of a value that ends here."""
        name = F.regexp_extract(F.coalesce(s["buf"], F.lit("")), ANCHOR, 1)
        one = F.array(F.struct(name.alias("n"), value.alias("y"))).cast(_ANCHORS)
        return F.when(F.startswith(s["buf"], F.lit("&")) & value.isNotNull(), F.concat(s["anchors"], one)).otherwise(s["anchors"])

    def failed(value: Column) -> Column:
        return s["bad"] | (s["buf"].isNotNull() & value.isNull())

    def ended(value: Column) -> Column:
        y = F.concat(s["y"], F.coalesce(value, F.lit("")), F.when(s["want"], "null").otherwise(""), closed(s["stack"]))
        return state(y, s["stack"], s["want"], s["wc"], s["buf"], s["bc"], noted(value), failed(value))

    def structure(x: Column, value: Column) -> Column:
        dashes = F.regexp_extract(x["text"], r"\A((?:-[ \t]+)*(?:-\z)?)", 1)
        groups = F.when(dashes == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(dashes, F.lit(r"(-[ \t]*)"), 1))
        return let(
            F.struct(
                x["indent"].alias("at"),
                F.transform(groups, lambda _, i: x["indent"] + F.length(F.array_join(F.slice(groups, F.lit(1), i), ""))).alias("cols"),
                F.substring(x["text"], F.length(dashes) + 1, F.lit(1 << 20)).alias("rest"),
                (x["indent"] + F.length(dashes)).alias("cr"),
            ),
            lambda t: placed(t, value),
        )

    def placed(t: Column, value: Column) -> Column:
        is_list = F.size(t["cols"]) > 0
        is_key = F.rlike(t["rest"], F.lit(KEY_LINE))
        stays = lambda o: (o["c"] < t["at"]) | ((o["c"] == t["at"]) & (is_list | (o["k"] == "m")))
        return let(
            F.struct(F.filter(s["stack"], stays).alias("kept"), is_list.alias("is_list"), is_key.alias("is_key")),
            lambda p: opened(t, p, value),
        )

    def opened(t: Column, p: Column, value: Column) -> Column:
        is_list, is_key, kept = p["is_list"], p["is_key"], p["kept"]
        top = F.try_element_at(kept, F.lit(-1))
        deeper = (t["at"] > s["wc"]) | (is_list & (t["at"] == s["wc"]) & F.coalesce(top["k"] == "m", F.lit(True)))
        return let(s["want"] & deeper, lambda new: emitted(t, p, top, new, value))

    def emitted(t: Column, p: Column, top: Column, new: Column, value: Column) -> Column:
        is_list, is_key, kept = p["is_list"], p["is_key"], p["kept"]
        gone = F.slice(s["stack"], F.size(kept) + 1, F.greatest(F.size(s["stack"]) - F.size(kept), F.lit(0)))
        follows = F.coalesce((top["c"] == t["at"]) & F.when(is_list, top["k"] == "s").otherwise(is_key & (top["k"] == "m")), F.lit(False))
        lists = F.transform(F.filter(t["cols"], lambda _, i: new | (i > 0)), lambda c: _level(c, "s"))
        is_map = is_key & (is_list | new)
        key = F.regexp_extract(t["rest"], KEY_LINE, 1)
        given = F.coalesce(F.when(is_key, F.regexp_extract(t["rest"], KEY_LINE, 2)).otherwise(t["rest"]), F.lit(""))
        holds = ~F.rlike(given, F.lit(r"\A(?:&[^\s\[\]{},]+)?\s*(?:#.*)?\z"))
        parent = F.when(is_key, t["cr"]).when(is_list, F.try_element_at(t["cols"], F.lit(-1))).otherwise(s["wc"])
        y = F.concat(
            s["y"],
            F.coalesce(value, F.lit("")),
            F.when(s["want"] & ~new, "null").otherwise(""),
            closed(gone),
            F.when(new, "").otherwise(","),
            F.repeat(F.lit("["), F.size(lists)),
            F.when(is_map, "{").otherwise(""),
            F.when(is_key, F.concat(_key_json(key), F.lit(":"))).otherwise(""),
        )
        return state(
            y,
            F.concat(kept, lists, F.when(is_map, F.array(_level(t["cr"], "m"))).otherwise(F.array().cast(_LEVELS))),
            ~holds,
            parent,
            F.when(holds, given),
            parent,
            noted(value),
            failed(value) | ~(new | follows),
        )

    text = trim_ws(line)
    return let(F.struct(F.length(F.regexp_extract(line, r"\A([ \t]*)", 1)).alias("indent"), text.alias("text")), of)


def _key_json(key: Column) -> Column:
    """A key as a JSON string."""
    inner = F.substring(key, F.lit(2), F.length(key) - 2)
    return (
        F.when(F.startswith(key, F.lit('"')), _escaped(key))
        .when(F.startswith(key, F.lit("'")), json_string(F.replace(inner, F.lit("''"), F.lit("'"))))
        .otherwise(json_string(key))
    )


def _root_entries(block: Column) -> Column:
    """The ``key: value`` parts of a block that is one flow map."""
    inner = F.substring(block, F.lit(2), F.length(block) - 2)

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(t.isin("[", "{"), 1).when(t.isin("]", "}"), -1).otherwise(0)
        cut = (t == ",") & (s["depth"] == 0)
        spaced = F.when(t.isin(":", ","), F.concat(t, F.lit(" "))).otherwise(t)
        return F.struct(
            depth.alias("depth"),
            F.when(cut, "").otherwise(F.concat(s["now"], spaced)).alias("now"),
            F.when(cut, F.concat(s["parts"], F.array(s["now"]))).otherwise(s["parts"]).alias("parts"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast("array<string>").alias("parts"))
    return F.aggregate(
        F.regexp_extract_all(inner, F.lit(FLOW_TOKEN), 1), start, step, lambda s: F.concat(s["parts"], F.array(s["now"]))
    )


def _quote_dates(y: Column) -> Column:
    """JSON text of a flow text: bare dates are quoted, infinite numbers null."""
    special = F.rlike(y, F.lit(r"(?:\A|[\[,:])(?:\d{4}-\d{2}-\d{2}T|[-+]?\.[in])"))
    finite = F.regexp_replace(y, rf"({JSON_STRING})|[-+]?\.(?:inf|nan)", "$1\u0003")
    # A string keeps its own end; what is left of a number becomes null.
    finite = F.replace(F.replace(finite, F.lit('"\u0003'), F.lit('"')), F.lit("\u0003"), F.lit("null"))
    marked = F.regexp_replace(finite, rf'({JSON_STRING})|(\d{{4}}-\d{{2}}-\d{{2}}T[\d:.]+Z)', "$1\u0001$2\u0002")
    # A marked string ends in an empty pair; a marked date sits inside the pair.
    quoted = F.replace(marked, F.lit("\u0001\u0002"), F.lit(""))
    return F.when(special, F.translate(quoted, "\u0001\u0002", '""')).otherwise(y)


def block_text(content: Column | str) -> Column:
    """Text between the fences; empty without a block."""
    return F.when(
        F.rlike(content, F.lit(r"\A\ufeff?---")), F.regexp_extract(content, BLOCK, 1)
    ).otherwise(F.lit(""))


@_once
def raw_entries(content: Column | str) -> Column:
    """Entries as written; ``y`` is null where the value is outside the grammar."""
    block = trim_ws(F.regexp_replace(block_text(content), r"(?m)^#[^\n]*(?:\n|\z)", ""))

    def chunks(b: Column) -> Column:
        return F.filter(F.when(F.rlike(b, F.lit(ROOT_MAP)), _root_entries(b)).otherwise(F.split(b, NEXT_ENTRY)), lambda e: e != "")

    def entry(whole: Column) -> Column:
        return let(F.split(whole, r"\r?\n"), lambda lines: read(whole, lines))

    def read(whole: Column, lines: Column) -> Column:
        first = F.get(lines, F.lit(0))
        is_entry = F.rlike(first, F.lit(KEY_LINE))
        key = F.regexp_extract(first, KEY_LINE, 1)
        rest = F.coalesce(F.regexp_extract(first, KEY_LINE, 2), F.lit(""))
        holds = ~F.rlike(rest, F.lit(r"\A(?:&[^\s\[\]{},]+)?\s*(?:#.*)?\z"))
        start = F.struct(
            F.lit("").alias("y"), F.array().cast(_LEVELS).alias("stack"), (~holds).alias("want"), F.lit(0).alias("wc"),
            F.when(holds, rest).alias("buf"), F.lit(0).alias("bc"), F.array().cast(_ANCHORS).alias("anchors"), F.lit(False).alias("bad"),
        ).cast(_FOLD)
        below = F.concat(F.slice(lines, F.lit(2), F.size(lines)), F.array(F.lit(END)))
        folded = F.aggregate(below, start, _fold_line)
        # Most entries are one line, which needs no fold.
        alone = let(
            _rendered(rest),
            lambda y: F.struct(
                y.alias("y"), start["stack"].alias("stack"), F.lit(False).alias("want"), F.lit(0).alias("wc"), rest.alias("buf"), F.lit(0).alias("bc"),
                F.when(F.startswith(rest, F.lit("&")), F.array(F.struct(F.regexp_extract(rest, ANCHOR, 1).alias("n"), y.alias("y"))))
                .otherwise(F.array()).cast(_ANCHORS).alias("anchors"),
                y.isNull().alias("bad"),
            ).cast(_FOLD),
        )
        folded = F.when((F.size(lines) == 1) & holds, alone).otherwise(folded)
        unquoted = F.get_json_object(F.concat(F.lit('{"k":'), _key_json(key), F.lit("}")), "$.k")
        name = F.when(~is_entry, F.concat(F.lit(RAW), whole)).when(F.rlike(key, F.lit(r"\A[\"']")), unquoted).otherwise(key)
        # A merge key would have to be spread over the map; a key given twice makes no value.
        fine = is_entry & (key != "<<")

        def readable(y: Column) -> Column:
            # Inside a map, so that nothing may follow the value.
            return F.try_parse_json(F.concat(F.lit('{"v":'), _quote_dates(y), F.lit("}"))).isNotNull()

        def made(s: Column) -> Column:
            y = F.when(fine & ~s["bad"] & (~F.rlike(s["y"], F.lit(r"\A[\[{]")) | readable(s["y"])), s["y"])
            whole_value = F.regexp_extract(rest, ANCHOR, 1)
            anchors = F.concat(
                s["anchors"],
                F.when(~holds & (whole_value != "") & y.isNotNull(), F.array(F.struct(whole_value.alias("n"), y.alias("y")))).otherwise(F.array()).cast(_ANCHORS),
            )
            return F.struct(name.alias("k"), y.alias("y"), whole.alias("raw"), anchors.alias("anchors"))

        return let(folded, made)

    parsed = let(block, lambda b: F.transform(chunks(b), entry))
    resolved = let(parsed, lambda es: F.when(F.exists(es, lambda e: F.contains(e["y"], F.lit(NAMED))), _resolved(es)).otherwise(es))
    return F.transform(
        resolved, lambda e: F.struct(e["k"].alias("k"), e["y"].alias("y"), _quote_dates(e["y"]).alias("j"), e["raw"].alias("raw"))
    )


def _resolved(entries_: Column) -> Column:
    """Entries with the anchored values, their own or those of entries before, in place of aliases."""

    def looked_up(y: Column, anchors: Column) -> Column:
        named = lambda a: F.concat(F.lit('"' + NAMED), a["n"], F.lit(NAMED + '"'))
        return F.aggregate(anchors, y, lambda out, a: F.replace(out, named(a), a["y"]))

    def step(s: Column, e: Column) -> Column:
        # Of two anchors of one name the later one holds.
        def added(own: Column) -> Column:
            y = looked_up(e["y"], F.reverse(F.concat(s["anchors"], own)))
            whole = F.struct(
                e["k"].alias("k"), F.when(~F.contains(y, F.lit(NAMED)), y).alias("y"), e["raw"].alias("raw"), e["anchors"].alias("anchors")
            )
            return F.struct(F.concat(s["entries"], F.array(whole)).alias("entries"), F.concat(s["anchors"], own).alias("anchors"))

        own = F.transform(e["anchors"], lambda a: F.struct(a["n"].alias("n"), looked_up(a["y"], F.reverse(s["anchors"])).alias("y")))
        return let(own, added)

    start = F.struct(F.slice(entries_, F.lit(1), F.lit(0)).alias("entries"), F.array().cast(_ANCHORS).alias("anchors"))
    return F.aggregate(entries_, start, step, lambda s: s["entries"])


def _first_of_key(entries: Column) -> Column:
    """Entries but for those whose key came before."""
    keys = F.transform(entries, lambda e: e["k"])
    return F.filter(entries, lambda e, i: F.array_position(keys, e["k"]) == i + 1)


def _is_bad(entries: Column) -> Column:
    return F.exists(entries, lambda e: e["y"].isNull()) | (
        F.size(F.array_distinct(F.transform(entries, lambda e: e["k"]))) != F.size(entries)
    )


def _read(entries: Column) -> Column:
    """The entries that could be read."""
    kept = F.filter(_first_of_key(entries), lambda e: e["y"].isNotNull())
    return F.transform(kept, lambda e: F.struct(e["k"].alias("k"), e["y"].alias("y"), e["j"].alias("j"))).cast(ENTRIES)


@_once
def entries(content: Column | str) -> Column:
    """Parsed properties in source order; what can't be read is left out."""
    parsed = let(raw_entries(content), _read)
    return F.when(F.rlike(content, F.lit(OPENING)), parsed).otherwise(F.array().cast(ENTRIES))


@_once
def kept_entries(content: Column | str) -> Column:
    """All entries as ``struct<k, y>`` for a merge; those that can't be read carry their text as it is."""
    def all_of(es: Column) -> Column:
        return F.transform(
            _first_of_key(es),
            lambda e: F.struct(e["k"].alias("k"), F.coalesce(e["y"], F.concat(F.lit(RAW), e["raw"])).alias("y")),
        )

    return F.when(F.rlike(content, F.lit(OPENING)), let(raw_entries(content), all_of)).otherwise(
        F.array().cast("array<struct<k:string,y:string>>")
    )


@_once
def unclosed(content: Column | str) -> Column:
    """A block opens and never ends."""
    return F.rlike(content, F.lit(OPENING)) & ~F.rlike(content, F.lit(BLOCK))


@_once
def frontmatter_error(content: Column | str) -> Column:
    """True where a property block opens but not all of it can be read."""
    opens = F.rlike(content, F.lit(OPENING))
    return opens & (unclosed(content) | let(raw_entries(content), _is_bad))


def entries_text(es: Column) -> Column:
    pairs = F.transform(es, lambda e: F.concat(json_string(e["k"]), F.lit(":"), e["j"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


@_once
def frontmatter_text(content: Column | str) -> Column:
    """Properties as JSON text in source order; ``{}`` when there are none."""
    return F.when(F.rlike(content, F.lit(OPENING)), entries_text(entries(content))).otherwise(
        F.lit("{}")
    )


@_once
def frontmatter(content: Column | str) -> Column:
    """Properties as VARIANT."""
    return F.parse_json(frontmatter_text(content))


@_once
def frontmatter_map(content: Column | str) -> Column:
    """Flat properties as ``map<string, json text>``."""
    return F.map_from_entries(
        F.transform(entries(content), lambda e: F.struct(e["k"].alias("key"), e["j"].alias("value")))
    )


@_once
def frontmatter_body(content: Column | str) -> Column:
    """Text after the block."""
    return F.when(
        F.rlike(content, F.lit(r"\A\ufeff?---")), F.regexp_replace(content, BLOCK, "")
    ).otherwise(_col(content))


def flatten_tags(value: Column) -> Column:
    """Tag names in a property value given as JSON or YAML flow text.

    Strings are split at commas and white space and lose one leading ``#``;
    lists of any depth are flattened; other values hold no tags.
    """
    map_text = r'\{(?:[^{}"]|"(?:[^"\\]|\\.)*+")*+\}'

    def strings(v: Column) -> Column:
        tokens = F.array_join(F.regexp_extract_all(v, F.lit(JSON_STRING), 0), ",")
        return F.from_json(F.concat(F.lit("["), tokens, F.lit("]")), "array<string>")

    def without_maps(v: Column) -> Column:
        # Maps inside a list hold no tags; peel them from the inside out, as often as there are braces.
        braces = F.length(v) - F.length(F.replace(v, F.lit("{"), F.lit("")))
        peeled = F.aggregate(F.sequence(F.lit(1), F.greatest(braces, F.lit(1))), v, lambda out, _: F.regexp_replace(out, map_text, "0"))
        return F.when(braces > 0, peeled).otherwise(v)

    def split_tags(s: Column) -> Column:
        parts = F.filter(F.split(s, f"[{WS[1:-1]},]+"), lambda t: t != "")
        return F.transform(parts, lambda t: F.regexp_replace(t, r"\A#", ""))

    flat = F.flatten(F.transform(strings(without_maps(value)), split_tags))
    return F.when(F.rlike(value, F.lit(r'\A\s*["\[]')), flat).otherwise(
        F.array().cast("array<string>")
    )


@_once
def frontmatter_tags(content: Column | str) -> Column:
    """Tags of the ``tags`` property."""
    tagged = F.filter(entries(content), lambda e: e["k"] == "tags")
    return F.when(
        F.rlike(content, F.lit(r"\A\ufeff?---")) & F.contains(content, F.lit("tags")),
        F.flatten(F.transform(tagged, lambda e: flatten_tags(e["y"]))),
    ).otherwise(F.array().cast("array<string>"))


def merge_entries(base: Column, new: Column) -> Column:
    """Shallow merge of ``struct<k, y>`` arrays: old keys keep their place, new
    values win, new keys follow in the order of their first mention."""

    def last(key: Column) -> Column:
        return F.try_element_at(F.filter(new, lambda n: n["k"] == key), F.lit(-1))["y"]

    def pair(key: Column, y: Column) -> Column:
        return F.struct(key.alias("k"), y.alias("y"))

    updated = F.transform(base, lambda e: pair(e["k"], F.coalesce(last(e["k"]), e["y"])))
    names = F.array_except(F.transform(new, lambda n: n["k"]), F.transform(base, lambda e: e["k"]))
    return F.concat(updated, F.transform(names, lambda k: pair(k, last(k))))


def render(es: Column, body: Column) -> Column:
    """A note with the given ``struct<k, y>`` entries in front of ``body``."""
    plain_key = r"\A[A-Za-z_][\w .-]*(?<! )\z"
    def line(e: Column) -> Column:
        key = F.when(F.rlike(e["k"], F.lit(plain_key)), e["k"]).otherwise(json_string(e["k"]))
        as_it_was = F.concat(F.substring(e["y"], F.lit(2), F.length(e["y"])), F.lit("\n"))
        return F.when(F.startswith(e["y"], F.lit(RAW)), as_it_was).otherwise(F.concat(key, F.lit(": "), e["y"], F.lit("\n")))

    lines = F.transform(es, line)
    return F.when(
        F.size(es) > 0, F.concat(F.lit("---\n"), F.array_join(lines, ""), F.lit("---\n"), body)
    ).otherwise(body)
