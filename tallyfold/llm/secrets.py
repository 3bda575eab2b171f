"""Secret scans: three exact patterns, and sliding-window entropy for secrets that no pattern names.

DataFrame functions only. A regular expression's matches and the pieces between them give every match's place in
code points, by prefix sums; a fold over a candidate's characters keeps the counts of the window's characters, one in
and one out at a step, and so its Shannon entropy. No step looks back at the text, so that long candidates cost in
proportion, and many matches nearly so.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a maximal run of 20 or more characters; a shorter run holds no longer one
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6

#: Character classes of the entropy scan: kind, candidate strings, alphabet, window, least entropy in bits a character.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CLASSES = (
    ("entropy_base64", r"[A-Za-z0-9+/_-]{20,}={0,2}", _LETTERS + "0123456789+/_-=", 20, 3.8),
    ("entropy_hex", r"(?<![A-Za-z0-9])[0-9A-Fa-f]{16,}(?![A-Za-z0-9])", "0123456789abcdefABCDEF", 16, 3.0),
)
#: Allow-list. No window of a secret holds a placeholder: words, and runs of one character.
PLACEHOLDERS = (("example", False), ("placeholder", False), ("changeme", False), ("dummy", False), ("1234567890", True), ("xxxxxx", False), ("00000000", True))
#: Stretches that are no secrets: without a digit, or without a letter; candidates that are none: a UUID.
PLAIN = (r"^[^0-9]*$", r"^[^A-Za-z]*$")
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Sums of c log2 c are kept as whole numbers of so small a unit: moving a window leaves no rounding behind.
UNIT = 1 << 40
#: Code points of a piece by which a text is cut up for redaction.
PIECE = 4_096

_SPAN = "struct<start:int,rank:int,end:int,kind:string>"
_NONE = f"cast(array() as array<{_SPAN}>)"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """body, in which name stands for value: a lambda's variable is computed once, where a column might be put in again and again."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(values: str, combine: str) -> str:
    """Running totals of an array under combine(a, b), by doubling: about log2 n passes, none of which copies more than the array."""
    return _let(
        "vs",
        values,
        f"""aggregate(sequence(0, greatest(0, cast(ceil(log2(size(vs))) as int) - 1)), vs,
        (acc, step) -> transform(acc, (b, i) -> if(i < shiftleft(1, step), b, {combine.replace("(a)", "acc[i - shiftleft(1, step)]").replace("(b)", "b")})))""",
    )


_SUM, _MAX = "(a) + (b)", "greatest((a), (b))"


def _matches(pattern: str, keep: str, made: str, none: str) -> str:
    """made of every match x of the pattern in the column `text`, from `start` to `end`, that `keep` accepts."""
    p = _quoted(pattern)
    ends = _running("transform(ms, (x, i) -> char_length(gs[i]) + char_length(x))", _SUM)
    found = f"transform(filter(zip_with(ms, es, (x, e) -> named_struct('x', x, 'end', e)), m -> {keep.replace('(x)', 'm.x')}), m -> {made.replace('(x)', 'm.x').replace('(start)', 'm.end - char_length(m.x)').replace('(end)', 'm.end')})"
    inner = _let("gs", f"split(text, {p}, -1)", _let("es", ends, found))
    return f"if(text rlike {p}, {_let('ms', f'regexp_extract_all(text, {p}, 0)', inner)}, {none})"


def _base() -> Column:
    span = lambda kind, rank: f"named_struct('start', (start), 'rank', {rank}, 'end', (end), 'kind', '{kind}')"
    long = f"char_length(regexp_extract((x), {_quoted(ASSIGN)}, 2)) >= {ASSIGN_LEAST}"
    parts = [_matches(p, keep, span(kind, rank), _NONE) for rank, (kind, p, keep) in enumerate((("assign", ASSIGN, long), ("access", ACCESS, "true"), ("hex", HEX, "true")))]
    return F.expr(f"array_sort(concat({', '.join(parts)}))")


def _outside(found: str) -> str:
    """The candidates that no base span holds: those that end after every base span that starts before them."""
    events = f"array_sort(concat(transform(spans_base, b -> named_struct('start', b.start, 'own', 0, 'end', b.end, 'text', '')), transform({found}, f -> named_struct('start', f.start, 'own', 1, 'end', f.end, 'text', f.text))))"
    reach = _running("transform(ev, e -> if(e.own = 0, e.end, 0))", _MAX)
    left = f"transform(filter(zip_with(ev, {reach}, (e, r) -> named_struct('e', e, 'r', r)), z -> z.e.own = 1 and z.r < z.e.end), z -> z.e)"
    return f"if(size({found}) = 0, cast(array() as array<struct<start:int,own:int,end:int,text:string>>), {_let('ev', events, left)})"


def _entropy(kind: str, rank: int, alphabet: str, window: int, least: float) -> str:
    """For each candidate in the column `found` (start, text): from its first to its last window of high entropy.

    The sum of c log2 c over the counts c of a window's characters changes, at each step, by the terms of the
    character that comes in and of the one that goes out. Placeholders are characters of no alphabet, number 0, and
    their windows don't count.
    """
    term = [round(c * math.log2(c) * UNIT) if c else 0 for c in range(window + 2)]
    grows = "array(" + ", ".join(f"{b - a}L" for a, b in zip(term, term[1:])) + ")"  # by one more of a character
    most = round(((math.log2(window) - least) * window + 1e-9) * UNIT)
    masked = "f.text"
    for word, cased in PLACEHOLDERS:
        masked = f"regexp_replace({masked}, '{'' if cased else '(?i)'}{word}', '{chr(0x20) * len(word)}')"
    codes = f"transform(split({masked}, ''), ch -> locate(ch, '{alphabet}'))"
    start = f"named_struct('s', 0L, 'counts', array_repeat(0, {len(alphabet) + 1}), 'lo', -1, 'hi', -1)"
    moved = _let(
        "m",
        f"named_struct('e', codes[i], 'l', if(i >= {window}, codes[i - {window}], -1))",
        _let(
            "n",
            f"""named_struct('s', if(m.e = m.l, acc.s, acc.s + {grows}[acc.counts[m.e]] - if(m.l < 0, 0L, {grows}[acc.counts[m.l] - 1])),
                'counts', if(m.e = m.l, acc.counts, transform(acc.counts, (c, k) -> c + if(k = m.e, 1, 0) - if(k = m.l, 1, 0))))""",
            _let("hot", f"i >= {window - 1} and n.s <= {most}L and n.counts[0] = 0", f"named_struct('s', n.s, 'counts', n.counts, 'lo', if(hot and acc.lo < 0, i - {window - 1}, acc.lo), 'hi', if(hot, i + 1, acc.hi))"),
        ),
    )
    stretch = f"aggregate(sequence(0, size(codes) - 1), {start}, (acc, i) -> {moved})"
    spans = f"transform(found, f -> {_let('h', _let('codes', codes, stretch), "named_struct('f', f, 'lo', h.lo, 'hi', h.hi)")})"
    plain = " or ".join(f"substring(z.f.text, z.lo + 1, z.hi - z.lo) rlike {_quoted(p)}" for p in PLAIN)
    return f"""transform(filter({spans}, z -> z.lo >= 0 and not ({plain}) and not (z.f.text rlike {_quoted(UUID)})),
        z -> named_struct('start', z.f.start + z.lo, 'rank', {rank}, 'end', z.f.start + z.hi, 'kind', '{kind}'))"""


def scan(docs: DataFrame) -> DataFrame:
    """Every column of docs, and spans_base, spans_all: arrays of start, rank, end, kind in code points, in order.

    Base spans are leftmost non-overlapping matches of each of the three patterns, less those too short. The other
    spans are stretches of strings of one character class whose sliding-window entropy is high, unless the stretch
    has no digit or no letter, the string is a UUID or lies within a base span; windows that hold a placeholder don't
    count. Null and empty texts have no spans; texts are scanned whole, however long; repeated rows stay; a column of
    docs that bears the name of one of ours is replaced by it.
    """
    held = docs.columns
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in held]).alias("row"), F.coalesce("text", F.lit("")).alias("text")).withColumn("spans_base", _base())
    more = []
    for k, (kind, pattern, alphabet, window, least) in enumerate(CLASSES):
        found = _matches(pattern, "true", "named_struct('start', (start), 'end', (end), 'text', (x))", "cast(array() as array<struct<start:int,end:int,text:string>>)")
        out = out.withColumn("found", F.expr(found)).withColumn("found", F.expr(_outside("found")))
        out = out.withColumn(f"more{k}", F.expr(f"if(size(found) = 0, {_NONE}, {_entropy(kind, 3 + k, alphabet, window, least)})"))
        more.append(F.col(f"more{k}"))
    out = out.withColumn("spans_all", F.array_sort(F.concat("spans_base", *more)))
    return out.select(*[F.col("row").getField(c).alias(c) for c in held if c not in ("spans_base", "spans_all")], "spans_base", "spans_all")


def _listed(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row of docs, from scan(), cases as there."""
    got = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    number = lambda kind: F.expr(f"cast(size(filter(spans_base, x -> x.kind = '{kind}')) as long)").alias(f"n_{kind}")
    return got.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(_listed("spans_base"), 256).alias("base_sha256"), _listed("spans_all").alias("spans"))


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """docs with every found span of the text replaced by the mark (overlapping spans by one), all columns kept. Null texts stay null."""
    # The text is cut into pieces once, so that what stands between two spans is found without a walk from the start.
    pieces = f"regexp_extract_all(text, '(?s).{{1,{PIECE}}}', 0)"
    reach = _running("transform(spans_all, x -> x.end)", _MAX)
    cut = lambda a, b: f"""array_join(transform(sequence(({a}) div {PIECE}, ({b}) div {PIECE}), k ->
        coalesce(substring(get(ps, cast(k as int)), greatest({a} - k * {PIECE}, 0) + 1, least({b} - k * {PIECE}, {PIECE}) - greatest({a} - k * {PIECE}, 0)), '')), '')"""  # noqa: E731
    gaps = "filter(transform(spans_all, (x, i) -> named_struct('a', if(i = 0, 0, rs[i - 1]), 'b', x.start)), z -> z.b >= z.a)"
    kept = f"array_join(concat(transform({gaps}, z -> {cut('z.a', 'z.b')}), array({cut('element_at(rs, -1)', 'n')})), {_quoted(mark)})"
    whole = f"if(size(spans_all) = 0, text, {_let('ps', pieces, _let('n', 'char_length(text)', _let('rs', reach, kept)))})"
    at = [F.col(f"`{c}`") if c != "text" else F.expr(whole).alias("text") for c in docs.columns]
    return scan(docs).select(*at)
