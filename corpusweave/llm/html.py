"""Main text of web pages by line-block distribution.

Markup is stripped into lines: each block element of the page gives a line, each element that is never part of the
article (menus, adverts, scripts, …) a blank one. The text lengths of a sliding window of lines are summed. Where the sum
surges above a threshold the main text begins, reaching back to the last gap; where it dives to nothing the text
ends. Outside the page's article element, if it has one, lines count as blank.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Lines of a window, and text of a window that marks a surge where no article element does.
WINDOW = 3
SURGE = 80
#: A line with this share of its text in links counts as blank outside an article element.
LINK_SHARE = 0.5

# Elements of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
DROPPED = frozenset(
    "head nav footer aside form script style noscript template iframe object svg canvas button select textarea "
    "menu dialog audio video map datalist title".split()
)
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLES = frozenset(("article", "main"))
#: Elements whose end also ends what was left open in them; the ends of the others may be missing themselves.
ENDERS = (BLOCKS | {"html", "body"}) - {"p", "li", "dd", "dt", "option", "br", "hr"}
#: Words of class, id and role that mark what is not part of the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|"
    r"alerts?|comments?|disqus|replies|responses|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|"
    r"share|sharing|social|related|recommended|recommendations|subscribe|subscription|newsletter|popup|modal|overlay|toolbar|"
    r"widget|contentinfo|complementary|search)(?:$|[\s_-])",
    re.IGNORECASE,
)

#: Classes of an article that tell of its page or topic, not of what it is.
_STATES = re.compile(
    r"(?:^|(?<=\s))(?:(?:has|with|without|no|category|tag|type|format|status|layout)[_-]\S+|\S+[_-](?:open|closed|enabled|disabled))"
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?][^>]*+>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)


def _unwanted(name: str, attributes: str, in_article: bool) -> bool:
    if name in DROPPED:
        return True
    if name == "header" and not in_article:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for kind, *values in _ATTRIBUTE.findall(attributes):
        value, kind = "".join(values), kind.lower()
        if kind == "hidden" or kind == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ARTICLES:
            value = _STATES.sub("", value)
        if kind in ("class", "id", "role") and MARKS.search(value):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """Text, characters in links and whether in an article, of each line; removed elements give blank lines."""
    out: list[tuple[str, int, bool]] = []
    text: list[str] = []
    links = depth = 0
    articles = 0
    opened: Counter[str] = Counter()  # elements that are open, outside of what is skipped
    inner: Counter[str] = Counter()  # and in it, itself among them
    skip, in_link = "", False
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal links
        line = " ".join("".join(text).split())
        if line:
            out.append((line, links, articles > 0))
        text.clear()
        links = 0

    while at < end:
        found = _TOKEN.search(page, at)
        begin = found.start() if found else end
        if begin > at and not skip:
            part = page[at:begin]
            if "&" in part:
                part = entities.unescape(part)
            text.append(part)
            if in_link:
                links += len(part)
        if not found:
            break
        at = found.end()
        close, name, attributes = found.group(1), found.group(2), found.group(3)
        if name is None:
            close, name, attributes = found.group(4), found.group(5), found.group(6)
        if name is None:  # a comment or declaration
            continue
        name = name.lower()
        if skip:
            if not close:
                inner[name] += name not in VOID and not attributes.endswith("/")
                continue
            if inner[name]:
                inner[name] -= 1
                if name == skip and not inner[name]:
                    skip = ""
                continue
            # An unclosed element ends with one that was opened before it; within a table, only with the article or page.
            if name not in ENDERS or not opened[name] or inner["table"] and name not in (*ARTICLES, "body", "html"):
                continue
            skip = ""
        if not close and _unwanted(name, attributes, articles > 0):
            flush()
            out.append(("", 0, articles > 0))
            if name in RAW:
                stop = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
                at = stop.end() if stop else end
            elif name not in VOID and not attributes.endswith("/"):
                skip, inner = name, Counter((name,))
            continue
        if name in ENDERS and not attributes.endswith("/"):
            opened[name] = max(0, opened[name] - 1) if close else opened[name] + 1
        if name == "a":
            in_link = not close
        if name in BLOCKS:
            flush()
            if name in ARTICLES:
                articles = max(0, articles - 1) if close else articles + 1
    flush()
    return out


def main_text(page: str | None) -> str:
    """The main text: lines between surges and dives, joined by one line break; empty if there is none."""
    if not page:
        return ""
    lines = lines_of(page)
    marked = any(inside and line for line, _, inside in lines)
    if marked:
        lengths = [len(line) if inside else 0 for line, _, inside in lines]
        surge = 1
    else:
        lengths = [0 if links >= LINK_SHARE * len(line) else len(line) for line, links, _ in lines]
        surge = SURGE
    n = len(lengths)
    if not any(lengths):
        return ""
    total = np.concatenate([[0], np.cumsum(lengths), np.full(WINDOW, sum(lengths))])
    sums = total[WINDOW : WINDOW + n] - total[:n]  # of the window that begins at each line
    surge = min(surge, int(sums.max()))  # a page of short lines only has its densest part
    kept: list[str] = []
    stretch: list[int] = []
    surged = False
    for at in range(n + 1):
        if at < n and sums[at] > 0:
            stretch.append(at)
            surged = surged or sums[at] >= surge
            continue
        if surged:
            kept.extend(lines[i][0] for i in stretch if lengths[i])
        stretch, surged = [], False
    return "\n".join(kept)


def _extract(column: pa.Array) -> pa.Array:
    return pa.array([main_text(page) for page in column.to_pylist()], pa.string())


def extracted(html: Column) -> Column:
    """Main text of a page. Null, empty and markup-only pages give the empty text; unclosed and overlapping tags
    are taken as they come, and a page of any length is read whole."""
    return arrow_udf(_extract, "string").asNondeterministic()(html.cast("string"))
