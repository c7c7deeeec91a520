"""SQL text for regex operations that Spark has no function for: matches with their offsets.

Expressions are built as SQL text, which Spark parses much faster than it takes nested Python lambdas. Offsets
are code points from 0. Patterns are written in the common dialect; java() adds the flags under which the JVM
reads them as Unicode patterns whose only line end is the line feed.
"""

from __future__ import annotations

import re
from re import _parser as sre

# White space, at the ends of a text and after an end mark.
SPACE = r"\s+"
ENDS = r"^\s+|\s+$"
SENTENCE_END = r"(?<=[.!?])\s+"
#: Stands in a masked text for a quotation.
QUOTE_MASK = "\x00QUOTE\x00"


def lit(text: str) -> str:
    """A SQL string literal."""
    out = text.replace("\\", "\\\\").replace("'", "\\'")
    return "'" + "".join(c if c >= " " else f"\\u{ord(c):04x}" for c in out) + "'"


def java(pattern: str, flags: str = "") -> str:
    return f"(?Ud{flags})" + pattern.replace("(?P<", "(?<")


def has(text: str, pattern: str, flags: str = "") -> str:
    return f"({text} RLIKE {lit(java(pattern, flags))})"


def strip(text: str) -> str:
    return f"regexp_replace({text}, {lit(java(ENDS))}, '')"


def cut(text: str, start: str, end: str) -> str:
    """text[start:end] with a start below 0 read as 0."""
    return f"substring({text}, greatest({start}, 0) + 1, greatest({end} - greatest({start}, 0), 0))"


def words(text: str) -> str:
    """Number of words between white space."""
    return f"size(filter(split({text}, {lit(java(SPACE))}), w -> w <> ''))"


def sentences(text: str) -> str:
    """Number of sentences: parts between white space that follows an end mark."""
    return f"size(filter(split({strip(text)}, {lit(java(SENTENCE_END))}), w -> w <> ''))"


SPAN = "array<struct<s:int,e:int,m:string,g:string,h:string>>"
NONE = f"cast(array() as {SPAN})"
#: Numbers that are added up in one fold; longer arrays are folded block by block, so that work grows with length.
FOLD = 256


def running(numbers: str) -> str:
    """array<int>: for each number the sum of those before it."""
    fold = lambda x, start: f"aggregate({x}, named_struct('at', {start}, 'out', cast(array() AS array<int>)), (a, v) -> named_struct('at', a.at + v, 'out', concat(a.out, array(a.at))), a -> a.out)"
    blocks = f"transform(sequence(0, size(l) - 1, {FOLD}), k -> slice(l, k + 1, {FOLD}))"
    sums = "transform(bs, b -> aggregate(b, 0, (x, y) -> x + y))"
    long = f"transform(array({blocks}), bs -> flatten(zip_with(bs, {fold(sums, '0')}, (b, z) -> {fold('b', 'z')})))[0]"
    return f"transform(array({numbers}), l -> IF(size(l) <= {FOLD}, {fold('l', '0')}, {long}))[0]"


def spans(text: str, pattern: str, flags: str = "", group: str = "", other: str = "") -> str:
    """array of (s, e, m, g, h): start, end and text of each match, and the groups named in `group` and `other` (like "$1").

    The matches and what stands between them, taken apart by the same pattern, give the offsets.
    """
    p = lit(java(pattern, flags))

    def groups(names: str) -> str:
        parts = [f"regexp_extract_all({text}, {p}, {n})" for n in names.replace("$", "")]
        return "null" if not parts else parts[0] if len(parts) == 1 else f"zip_with({parts[0]}, {parts[1]}, (x, y) -> concat(x, y))"

    taken = f"named_struct('w', regexp_extract_all({text}, {p}, 0), 'b', transform(split({text}, {p}, -1), x -> length(x)), 'g', {groups(group)}, 'h', {groups(other)})"
    steps = running("zip_with(o.w, slice(o.b, 1, size(o.w)), (x, y) -> length(x) + y)")
    shown = lambda k, names: f"o.{k}[i]" if names else "''"
    found = f"named_struct('s', at + o.b[i], 'e', at + o.b[i] + length(o.w[i]), 'm', o.w[i], 'g', {shown('g', group)}, 'h', {shown('h', other)})"
    return f"IF({text} RLIKE {p}, transform(array({taken}), o -> transform({steps}, (at, i) -> {found}))[0], {NONE})"


#: Letters that Java takes for ASCII ones where case is ignored, and those.
ODD_CASE = ("ſKıİ", "skii")
MOST_LITERALS, LEAST_LENGTH = 24, 3


def folded(text: str) -> str:
    """Text in which a pattern's literals() stand wherever it matches, case ignored or not."""
    return f"lower(translate({text}, '{ODD_CASE[0]}', '{ODD_CASE[1]}'))"


def literals(pattern: str) -> tuple[str, ...]:
    """Lower-case ASCII strings of which every match of a pattern has one; none if that can't be told or they are many or short."""
    try:
        found = _required(sre.parse(pattern))
    except (re.error, OverflowError):  # what only the JVM reads
        return ()
    return tuple(sorted(found)) if _usable(found) else ()


def _usable(found: set[str]) -> bool:
    return 0 < len(found) <= MOST_LITERALS and min(map(len, found)) >= LEAST_LENGTH


def _required(items) -> set[str]:
    """Of the parts of a sequence that every match has, the one with the longest and fewest strings."""
    parts, run = [], ""
    for op, value in [*items, (None, None)]:
        if op is sre.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        parts, run = [*parts, {run}] if run else parts, ""
        if op is sre.SUBPATTERN:
            parts.append(_required(value[3]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
            parts.append(_required(value[2]))
        elif op is sre.BRANCH:
            each = [_required(x) for x in value[1]]
            parts.append(set().union(*each) if all(each) else set())
    parts = [{x for x in p if not any(y != x and y in x for y in p)} for p in parts if p]
    return max(parts, key=lambda p: (_usable(p), min(map(len, p)), -len(p)), default=set())


def gated(test: str, pattern: str, low: str) -> str:
    """A test for a pattern's matches that is made only where one of its literals stands in `low`, the text folded()."""
    found = literals(pattern)
    return f"(({' OR '.join(f'contains({low}, {lit(x)})' for x in found)}) AND {test})" if found else test
