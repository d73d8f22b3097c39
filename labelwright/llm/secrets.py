"""Secret scan, in DataFrame operations only: one pass over the texts, no shuffle.

Base spans come from three fixed patterns. The method adds spans by entropy: a window of
``WINDOW`` characters slides over each run of token characters. Its state holds a count
per character (packed, ``PER_WORD`` to a long), the sum of n*log2(n) over the counts n, and
the last place of each character class: a character that comes in or goes out changes its
own count and term only. A window is random if it holds a letter and a digit and its
entropy reaches the threshold of its own class: hexadecimal, alphanumeric, or any token
character. So what stands before a secret ("KEY=", "id-") does not change how it is judged.

The allow-list suppresses windows, not runs: no window overlaps a match of ``ALLOWED``, so
runs are cut there; a run that is nothing but a path of words is left out whole. Windows
that overlap or touch become one span, unless a base span overlaps it.

Spans are offsets in code points, end exclusive. Built-in regular expressions give
strings without places, so places come from the lengths of what lies between matches.
Work is in proportion to a text's length, however long a run is or however many matches a
text has: runs pass in stretches of ``STRETCH`` windows, which overlap by a window less one,
and running sums go in two levels of ``BLOCK`` values.

Defined results: a null or empty text has no spans; spans of one kind never overlap;
overlapping spans of two kinds stay both; each row is scanned by itself, so repeated
rows repeat; extra columns stay, one named like the output is replaced; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from labelwright.llm.common import text_or_empty

ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
CANDIDATE = r"[A-Za-z0-9+/_-]+"
SYMBOLS = string.ascii_letters + string.digits + "+/_-"

WINDOW = 20
STRETCH = 256
BLOCK = 512
CHUNK = 4096
PER_WORD, BITS = 8, 7  # counts in a long, and bits of a count: windows of 127 at most
#: Bits per character of a window, by the narrowest class it belongs to.
CLASSES: Mapping[str, float] = {"hex": 3.0, "alnum": 3.7, "token": 3.9}
#: What looks random and is no secret: UUIDs, alphabets, placeholders.
ALLOWED = (
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r"[Aa][Bb][Cc][Dd][Ee][Ff][Gg][Hh][Ii][Jj]|0123456789|[Qq][Ww][Ee][Rr][Tt][Yy][Uu][Ii][Oo][Pp]",
    r"(?i:example|placeholder|changeme|your[_-]?(?:key|token|secret))",
)
#: A run without a match is a path of words: letters with up to four digits after them, apart
#: by ``/``, ``_`` or ``-``.
NOT_WORDS = r"\+|[0-9]{5}|[0-9][A-Za-z]|^[0-9_-]|^/([^A-Za-z]|$)"
KINDS = ("assign", "access", "hex", "entropy")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, add: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """For each of ``values`` (ints, none null), what those before it add up to."""
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))
    none = F.array().cast("array<int>")
    grow = lambda acc, v: state(add(acc.at, v), F.concat(acc.out, F.array(acc.at)))
    scan = lambda v, start: F.aggregate(v, state(start, none), grow, lambda acc: acc.out)

    def by_blocks(v: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")),
            lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)),
        )
        sums = lambda bs: F.transform(bs, lambda b: F.aggregate(b, F.lit(zero), add))
        return _bound(
            blocks, lambda bs: F.flatten(F.zip_with(bs, scan(sums(bs), F.lit(zero)), scan))
        )

    return _bound(values, lambda v: F.when(F.size(v) > 0, by_blocks(v)).otherwise(none))


def _cut(text: Column, pattern: str) -> Column:
    """The text in pieces (gap, match, gap_at, at): each match after what lies before it.

    The last piece has no match.
    """
    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.split(text, pattern, -1).alias("apart"),
    )

    def placed(v: Column) -> Column:
        gaps = F.transform(v.apart, F.length)
        sizes = F.zip_with(gaps, v.found, lambda g, m: g + F.coalesce(F.length(m), F.lit(0)))
        pieces = F.zip_with(
            v.apart, v.found, lambda g, m: F.struct(g.alias("gap"), m.alias("match"))
        )
        return F.zip_with(
            pieces, _running(sizes, lambda x, y: x + y),
            lambda p, at: F.struct(
                p.gap.alias("gap"), p.match.alias("match"), at.alias("gap_at"),
                (at + F.length(p.gap)).alias("start"),
            ),
        )

    return _bound(found, lambda v: F.when(F.size(v.found) > 0, placed(v)).otherwise(
        F.array(F.struct(
            text.alias("gap"), F.lit(None).cast("string").alias("match"),
            F.lit(0).alias("gap_at"), F.length(text).alias("start"),
        ))
    ))


def _places(text: Column, pattern: str) -> Column:
    """(match, start) of each leftmost non-overlapping match."""
    return F.transform(
        F.filter(_cut(text, pattern), lambda p: p.match.isNotNull()),
        lambda p: F.struct(p.match.alias("match"), p.start.alias("start")),
    )


def _span(rank: int):
    return lambda m: F.struct(
        m.start.alias("start"), F.lit(rank).alias("rank"),
        (m.start + F.length(m.match)).alias("end"),
    )


def base_spans(text: Column) -> Column:
    """Base spans of all kinds by start, then kind."""
    assign = F.filter(
        _places(text, ASSIGN), lambda m: F.length(F.regexp_extract(m.match, ASSIGN, 2)) >= 8
    )
    access = F.filter(_places(text, ACCESS), lambda m: F.length(m.match) >= 16)
    # A failing match of these two classes is a maximal run, so a longer minimum in the
    # pattern finds the same spans and far fewer strings.
    runs = _places(text, HEX[:-1] + "{32,}")
    return F.array_sort(
        F.concat(
            F.transform(assign, _span(0)), F.transform(access, _span(1)), F.transform(runs, _span(2))
        )
    )


def _slid(symbols: Column, window: int, last: Callable[[Column], Column], out: Callable) -> Column:
    """Fold over places in SYMBOLS: a window's state by incremental counts, and ``out`` gathered.

    ``out(state, place, entropy)`` is an array to append for each full window.
    """
    if not 1 < window < 1 << BITS:
        raise ValueError(f"window must be from 2 to {(1 << BITS) - 1}")
    terms = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)])
    word = lambda s: F.shiftright(s, PER_WORD.bit_length() - 1)
    shift = lambda s: (s % PER_WORD) * BITS
    unit = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), shift(s))
    count = lambda words, s: F.call_function(
        "shiftright", F.get(words, word(s)), shift(s)
    ).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    term = lambda n: F.get(terms, n)
    # Where a count changes: the word, and one unit at the count's place in it.
    change = lambda s, i: F.struct(
        i.alias("i"), s.alias("new"), word(s).alias("new_word"), unit(s).alias("new_unit"),
        F.get(symbols, i - window).alias("old"),
    )

    def step(acc: Column, c: Column) -> Column:
        old, leaves = c.old, c.old.isNotNull()
        gone = F.when(leaves, count(acc.words, old)).otherwise(F.lit(0))
        left = F.transform(
            acc.words,
            lambda w, k: F.when(leaves & (k == word(old)), w - unit(old)).otherwise(w),
        )
        t = acc.t - F.when(leaves, term(gone) - term(gone - 1)).otherwise(F.lit(0.0))

        def came(words: Column) -> Column:
            n = count(words, c.new)
            total = t + term(n + 1) - term(n)
            places = last(acc, c)
            return F.struct(
                total.alias("t"),
                F.transform(words, lambda w, k: F.when(k == c.new_word, w + c.new_unit).otherwise(w))
                .alias("words"),
                *[value.alias(name) for name, value in places.items()],
                F.when(
                    c.i >= window - 1,
                    F.concat(acc.out, out(places, c.i, F.lit(math.log2(window)) - total / window)),
                ).otherwise(acc.out).alias("out"),
            )

        return _bound(left, came)

    words = -(-len(SYMBOLS) // PER_WORD)
    start = F.struct(
        F.lit(0.0).alias("t"), F.array_repeat(F.lit(0).cast("long"), words).alias("words"),
        *[F.lit(-1).alias(name) for name in last(None, None)],
        out(None, None, None).alias("out"),
    )
    return F.aggregate(F.transform(symbols, change), start, step, lambda acc: acc.out)


def _symbols(text: Column) -> Column:
    """Each character's place in SYMBOLS."""
    return F.transform(F.split(text, ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)


def window_entropies(text: Column, window: int = WINDOW) -> Column:
    """Entropy in bits of each full window of a text of SYMBOLS, by its first place."""
    out = lambda places, i, h: F.array().cast("array<double>") if h is None else F.array(h)
    return _bound(_symbols(text), lambda s: _slid(s, window, lambda acc, c: {}, out))


def _random_windows(stretch: Column, window: int, classes: Mapping[str, float]) -> Column:
    """First places of a stretch's random windows."""
    names = ("letter", "digit", "not_hex", "not_alnum")

    def last(acc, c):
        if acc is None:
            return dict.fromkeys(names)
        letter, digit = c.new < 52, (c.new >= 52) & (c.new < 62)
        # Places 0 to 5 and 26 to 31 of SYMBOLS are the letters a to f.
        not_hex = ~(digit | (letter & (c.new % 26 < 6)))
        tests = (letter, digit, not_hex, c.new >= 62)
        return {n: F.when(test, c.i).otherwise(acc[n]) for n, test in zip(names, tests)}

    def out(places, i, h):
        if h is None:
            return F.array().cast("array<int>")
        first = i - window + 1
        bits = (
            F.when(places["not_hex"] < first, F.lit(classes["hex"]))
            .when(places["not_alnum"] < first, F.lit(classes["alnum"]))
            .otherwise(F.lit(classes["token"]))
        )
        random = (places["letter"] >= first) & (places["digit"] >= first) & (h >= bits - 1e-9)
        return F.when(random, F.array(first)).otherwise(F.array().cast("array<int>"))

    return _bound(_symbols(stretch), lambda s: _slid(s, window, last, out))


def _stretches(piece: Column, at: Column, window: int) -> Column:
    """(text, at): every window of the piece lies in exactly one of them."""
    chunks = F.regexp_extract_all(piece, F.lit(".{1,%d}" % STRETCH), F.lit(0))
    return _bound(chunks, lambda all_: F.transform(
        all_,
        lambda c, k: F.struct(
            F.concat(c, F.coalesce(F.substring(F.get(all_, k + 1), 1, window - 1), F.lit(""))).alias("text"),
            (at + k * STRETCH).cast("int").alias("at"),
        ),
    ))


def _joined(starts: Column, ends: Column) -> Column:
    """(start, end) of the unions of spans that overlap or touch; both in order, bound."""
    reach = lambda e: _running(e, lambda x, y: F.greatest(x, y), -1)

    def unions(reached: Column) -> Column:
        opens = F.filter(starts, lambda s, i: F.get(reached, i) < s)
        # A union ends at the furthest end before the next one opens.
        closes = F.filter(F.slice(reached, F.lit(2), F.size(reached)), lambda r, i: F.get(starts, i + 1) > r)
        return F.zip_with(
            opens, F.concat(closes, F.array(F.array_max(ends))),
            lambda s, e: F.struct(s.alias("start"), e.alias("end")),
        )

    return F.when(F.size(starts) > 0, _bound(reach(ends), unions)).otherwise(
        F.array().cast("array<struct<start:int,end:int>>")
    )


def entropy_spans(
    text: Column,
    window: int = WINDOW,
    classes: Mapping[str, float] = CLASSES,
    allowed: Sequence[str] = ALLOWED,
) -> Column:
    """Spans that the sliding entropy finds, before base spans are looked at."""
    runs = F.filter(
        _places(text, CANDIDATE[:-1] + "{%d,}" % window),
        lambda m: m.match.rlike("[0-9]") & m.match.rlike("[A-Za-z]") & m.match.rlike(NOT_WORDS),
    )
    suppressed = "|".join(f"(?:{pattern})" for pattern in allowed)
    pieces = F.flatten(F.transform(runs, lambda m: F.transform(
        _cut(m.match, suppressed) if allowed else F.array(
            F.struct(m.match.alias("gap"), F.lit(0).alias("gap_at"))),
        lambda p: F.struct(p.gap.alias("gap"), (m.start + p.gap_at).alias("at")),
    )))
    able = F.filter(
        pieces,
        lambda p: (F.length(p.gap) >= window) & p.gap.rlike("[0-9]") & p.gap.rlike("[A-Za-z]"),
    )
    stretches = F.flatten(F.transform(able, lambda p: _stretches(p.gap, p["at"], window)))
    hits = F.flatten(F.transform(
        stretches,
        lambda s: _bound(
            s["at"], lambda at: F.transform(_random_windows(s.text, window, classes), lambda i: i + at)
        ),
    ))
    return _bound(hits, lambda h: F.transform(
        _joined(h, F.transform(h, lambda i: i + window)),
        lambda u: F.struct(u.start.alias("start"), F.lit(3).alias("rank"), u.end.alias("end")),
    ))


def _apart(spans: Column, base: Column) -> Column:
    """The spans that no base span overlaps. ``base`` is in order of starts.

    A binary search finds how many base spans start before a span ends; one of those
    overlaps it if the furthest of their ends lies behind its start.
    """

    def search(v: Column) -> Column:
        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(v.starts) + F.lit(1.0))).cast("int"))

        def before(end: Column) -> Column:
            halve = lambda acc, _: _bound(
                F.floor((acc.low + acc.high) / 2).cast("int"),
                lambda mid: F.when(acc.low >= acc.high, acc).when(
                    F.get(v.starts, mid) < end,
                    F.struct((mid + 1).alias("low"), acc.high.alias("high")),
                ).otherwise(F.struct(acc.low.alias("low"), mid.alias("high"))),
            )
            whole = F.struct(F.lit(0).alias("low"), F.size(v.starts).alias("high"))
            return F.aggregate(steps, whole, halve, lambda acc: acc.low)

        return F.filter(spans, lambda e: F.get(v.reached, before(e.end)) <= e.start)

    ends = F.concat(F.transform(base, lambda b: b.end), F.array(F.lit(0)))
    known = F.struct(
        F.transform(base, lambda b: b.start).alias("starts"),
        _running(ends, lambda x, y: F.greatest(x, y)).alias("reached"),
    )
    return F.when((F.size(base) > 0) & (F.size(spans) > 0), _bound(known, search)).otherwise(spans)


def scan(
    docs: DataFrame,
    text_col: str = "text",
    out: str = "spans",
    window: int = WINDOW,
    classes: Mapping[str, float] = CLASSES,
    allowed: Sequence[str] = ALLOWED,
) -> DataFrame:
    """``docs`` with ``out``: array of (start, rank of the kind in KINDS, end), by start, then kind."""
    text = text_or_empty(text_col)
    found = F.struct(
        base_spans(text).alias("base"), entropy_spans(text, window, classes, allowed).alias("extra")
    )
    whole = _bound(found, lambda v: F.array_sort(F.concat(v.base, _apart(v.extra, v.base))))
    return docs.withColumn(out, whole)


def written(spans: Column, kinds: Sequence[str] = KINDS) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s.rank + 1), s.start.cast("string"),
                                  s.end.cast("string")),
        ),
        ",",
    )


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each span, or union of overlapping or touching spans, replaced by ``mask``."""
    chunks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))

    def without(v: Column) -> Column:
        def kept(a: Column, b: Column) -> Column:
            first = F.floor(a / CHUNK).cast("int")
            around = F.slice(v.chunks, first + 1, F.floor(b / CHUNK).cast("int") - first + 1)
            return F.substring(F.array_join(around, ""), a % CHUNK + 1, b - a)

        gaps = F.zip_with(
            F.concat(F.array(F.lit(0)), F.transform(v.unions, lambda u: u.end)),
            F.concat(F.transform(v.unions, lambda u: u.start), F.array(F.length(text))),
            kept,
        )
        return F.array_join(gaps, mask)

    unions = _bound(
        F.struct(
            F.transform(spans, lambda s: s.start).alias("starts"),
            F.transform(spans, lambda s: s.end).alias("ends"),
        ),
        lambda v: _joined(v.starts, v.ends),
    )
    known = F.struct(chunks.alias("chunks"), unions.alias("unions"))
    return F.when(F.size(spans) > 0, _bound(known, without)).otherwise(text)
