"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block; lines of menus, adverts, forms and the like are stripped to nothing with
their containers, but keep their places. Text lengths are summed over sliding windows of WINDOW lines. Where the sum
surges, a text begins, and it goes on until the sum dives to nothing. Gaps of WINDOW empty lines stand where the page's
own containers (article, main, the rest) meet, so that a stretch never runs from one into the other. The stretches
between surge and dive decide what is kept:

- Article and main elements that hold a stretch are kept whole, short lines before the surge and after the dive too;
  those without one (teasers) are dropped.
- Outside them the longest stretch shows the container of the main text: the least one around its long lines, where
  neighbours of the same tag and attributes are one container. All its lines are kept with the stretch; if it is the
  whole page, from the first surge on. It counts only if it has more than PRIOR times the characters of the stretches
  in article and main elements.

Defined results: null html counts as empty and gives an empty text; broken markup is read as far as it goes
(an unclosed script or comment ends the page); a very long page is read whole, in time proportional to its length; of
stretches of equal length the first counts; repeated rows each get their own result; an empty table gives an empty
result; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

WINDOW = 3
#: A surge of a text: so many characters in a window, or this share of the most.
SURGE_CHARS, SURGE_SHARE = 80, 0.35

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)""", re.S)
_SPACE = re.compile(r"\s+")
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas head select button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Containers that are tracked, those that are stripped wherever they are, and those stripped outside an article.
TRACKED = frozenset("div section nav header footer aside form main article ul ol table body dialog menu details figure fieldset".split())
STRIPPED = frozenset("nav footer aside form dialog menu fieldset".split())
STRIPPED_OUTSIDE = frozenset(["header"])
MAIN = frozenset(["article", "main"])
#: Containers that can be the main text's; lists, tables and figures stand in one.
HOLDING = frozenset("div section article main".split())
#: Containers nested deeper belong to the one at this depth.
DEEPEST = 200
#: So many characters of a stretch outside weigh as much as one in an article or main element.
PRIOR = 3
_NAME = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_BOILER = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|disqus|respond|footer|masthead|topbar|widget|pagination|pager|search|copyright|contentinfo|complementary)(?:[^a-z]|$)",
    re.I,
)


def lines_of(page: str) -> list[tuple[str, int, tuple]]:
    """(text, zone, containers) of each block in page order; zone 0 is outside article and main, others number those.

    The text of a stripped block is empty.
    """
    out: list[tuple[str, int, tuple]] = []
    buffer: list[str] = []
    stack: list[tuple[str, bool, int, tuple | None]] = []  # name, stripped, zone, containers as links to the outer ones
    zones, at = 0, 0

    def state():
        return stack[-1][1:] if stack else (False, 0, None)

    def close():
        if buffer:
            stripped, zone, inside = state()
            text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                out.append(("" if stripped else text, zone, inside))

    while True:
        m = _TAG.search(page, at)
        if not m:
            buffer.append(page[at:])
            close()
            return out
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        end, attributes = m[1] or m[4], m[3] if m[2] else m[6]
        if name in INLINE:
            if name in ("br", "img", "wbr"):
                buffer.append(" ")
            continue
        close()
        if name in RAW:
            if not end and not attributes.endswith("/"):
                done = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                if done:
                    at = done.end()
                elif name not in ("head", "title", "button", "select"):
                    return out
        elif name in TRACKED:
            if end:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            elif not attributes.endswith("/"):
                stripped, zone, inside = state()
                if not stripped and name != "body":
                    marks = " ".join(_NAME.findall(attributes))
                    stripped = name in STRIPPED or (name in STRIPPED_OUTSIDE and not zone) or (name not in MAIN and bool(_BOILER.search(marks))) or bool(_HIDDEN.search(attributes))
                if name in MAIN and not stripped and not zone:
                    zones += 1
                    zone = zones
                if name in HOLDING and (not inside or inside[0] < DEEPEST):
                    depth = inside[0] + 1 if inside else 1
                    inside = (depth, hash((inside and inside[1], name, attributes.strip())), inside)
                stack.append((name, stripped, zone, inside))


def common(a: tuple | None, b: tuple | None) -> tuple | None:
    """The innermost container that two lines share."""
    while a is not b and (a is None or b is None or a[1] != b[1]):
        if a is None or b is None:
            return None
        if a[0] >= b[0]:
            a, b = (a[2], b) if a[0] > b[0] else (a[2], b[2])
        else:
            b = b[2]
    return a


def stretches_of(rows: list[tuple[str, int, tuple | None]]) -> tuple[list[tuple[int, int, int]], list[int], float]:
    """(characters, from, to) of the lines between each surge and its dive; the lines' sizes; the sum that is a surge."""
    sizes = [len(t.replace(" ", "")) for t, _, _ in rows] + [0] * WINDOW
    sums = [sum(sizes[i : i + WINDOW]) for i in range(len(rows))]
    surge = min(SURGE_CHARS, SURGE_SHARE * max(sums, default=0))
    out, at = [], 0
    while at < len(rows):
        if sizes[at] and sums[at] >= surge:
            end = at
            while end < len(rows) and sums[end] >= surge and sizes[end]:
                end += 1
            # The dive: the windows that still hold the last long line.
            while end < len(rows) and sizes[end] and sizes[end] * WINDOW >= surge:
                end += 1
            out.append((sum(sizes[at:end]), at, end))
            at = end
        else:
            at += 1
    return out, sizes, surge


def extracted(page: str | None) -> tuple[str, int, int, int]:
    """The page's main text, its blocks joined by an empty line; how many blocks the page has, how many of them lie
    between a surge and a dive, and how many are kept."""
    # Lines with gaps between zones.
    rows: list[tuple[str, int, tuple | None]] = []
    lines = lines_of(page or "")
    for line in lines:
        if rows and rows[-1][1] != line[1]:
            rows += [("", line[1], None)] * WINDOW
        rows.append(line)
    stretches, sizes, surge = stretches_of(rows)
    if not stretches:
        return "", len(lines), 0, 0
    inside = [s for s in stretches if rows[s[1]][1]]
    outside = [s for s in stretches if not rows[s[1]][1]]
    zones = {rows[start][1] for _, start, _ in inside}
    most, start, end = max(outside, key=lambda s: (s[0], -s[1]), default=(0, 0, 0))
    kept = [bool(t) and zone in zones for t, zone, _ in rows]
    if most > PRIOR * sum(n for n, _, _ in inside):
        held = [rows[k][2] for k in range(start, end) if sizes[k] * WINDOW >= surge] or [rows[start][2]]
        holder = held[0]
        for c in held:
            holder = common(holder, c)
        first = outside[0][1]
        for k, (t, zone, c) in enumerate(rows):
            if t and not zone and (start <= k < end or (((x := common(c, holder)) and x[1] == holder[1]) if holder else k >= first)):
                kept[k] = True
    text = "\n\n".join(t for (t, _, _), keep in zip(rows, kept, strict=True) if keep)
    return text, len(lines), sum(end - start for _, start, end in stretches), sum(kept)


def main_text(page: str | None) -> str:
    return extracted(page)[0]


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, and n_blocks, n_between, n_kept as extracted() counts them: one row per page."""

    def run(batches):
        for b in batches:
            rows = [extracted(h) for h in b.column("html").to_pylist()]
            text, *counts = zip(*rows, strict=True) if rows else [()] * 4
            columns = [b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), *(pa.array(c, pa.int32()) for c in counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "n_blocks", "n_between", "n_kept"])

    return small_batches(pages).select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, n_blocks int, n_between int, n_kept int")


def query(spark, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
