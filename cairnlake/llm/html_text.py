"""Main text of web pages by line-block distribution (operator 1).

The markup is turned into lines: a block element ends a line, white space is one
space, and parts that never are main text (scripts, styles, forms, menus, headers,
footers, sidebars, notices, adverts, comments of readers) leave none.  The text
lengths over a sliding window of lines then show where the page's text surges and
where it dives, and what stands between the two is kept.  The article and main
elements are a hint where to look: with half of the page's text or more in them, the
distribution works on the lines inside, else on those of the whole page.  So are class
and id names: an element named as a part that never is main text isn't one if it holds
half of the page's text, and names that also occur in stories (``share``, ``legal``)
count for short elements and lists of links only.

One page is one row: nothing is shuffled, and memory is that of the largest page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlake.llm.runtime import trimmed

WINDOW = 3
SURGE = 80
SHORT = 100

# Fixed values of HTML: elements without a closing tag, elements whose text is data, elements that break a line.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_DATA = set("script style noscript template textarea title iframe svg select xmp noembed noframes".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_FRAME = set("nav header footer aside form button dialog menu head".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Words of a class or id that name what is not main text; those of _WEAK name short parts only.
_NAMES = set("ad ads adsense adslot banner nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer sidebar aside widget widgets comment comments commentlist disqus cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription pagination pager toolbar promo promos promotion sponsor sponsored sponsors teaser teasers".split())
_WEAK = set("header share sharing social related recommended recommendations respond reply replies signup login copyright legal disclaimer hidden".split())
_WHOLE = set("hidden sr-only visually-hidden screen-reader-text skip-link".split())
_ADVERT = re.compile(r"advert\w*")
#: Parts of a class that say how an element looks, or that another is near it.
_ABOUT = set("has no not with without is overflow show hide on off".split())
_OTHERS = set("ad ads comment comments reply replies related recommended teaser teasers promo sponsored".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|[^>])*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?", re.S)
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _named(name: str, words: set[str]) -> bool:
    """Whether one of the names in a class or id is one of ``words``, or put together with one."""
    for token in name.lower().split():
        parts = re.split(r"[-_]+", token)
        if token in _WHOLE and token in words | _WHOLE or not _ABOUT.intersection(parts) and any(x in words and x != "hidden" or words is _NAMES and _ADVERT.fullmatch(x) for x in parts):
            return True
    return False


def _frame(tag: str, rest: str, in_main: bool) -> str:
    """What an element is, going by its tag and attributes: "hard" and "named" are no main text, "weak" if short, "" is."""
    if tag in _FRAME and not (tag == "header" and in_main):
        return "hard"
    if not rest.strip():
        return ""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return "hard"
    if found.get("role", "").lower() in _ROLES:
        return "hard"
    if tag in ("html", "body", "main"):
        return ""
    names = [found[k] for k in ("class", "id") if found.get(k)]
    if tag == "article":  # comments and teasers are often articles of their own
        return "hard" if any(_named(x, _OTHERS) for x in names) else ""
    if any(_named(x, _NAMES) for x in names):
        return "named"
    if tag in _INLINE:  # a word in a sentence
        return "weak" if any(_WHOLE.intersection(x.lower().split()) for x in names) else ""
    return "weak" if any(_named(x, _WEAK - {"header"} if in_main else _WEAK) for x in names) else ""


def lines_of(html: str) -> list[tuple[str, int, bool]]:
    """(text, characters in links without white space, within an article or main element) of each line, without what frames the page."""
    lines: list[tuple[str, int, bool, tuple[int, ...]]] = []
    parts: list[str] = []
    linked, skipped, main, links = 0, 0, 0, 0
    stack: list[tuple[str, bool, bool, int]] = []  # tag, whether it starts a skipped part, whether it is the main part, its number if its name says that it is a frame, else -1
    inside: list[int] = []  # numbers of the open elements with such names
    named: list[tuple[str, bool]] = []  # "named" or "weak", whether within an article or main element
    at, end = 0, len(html)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            lines.append((text, linked, main > 0, tuple(inside)))
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not skipped:
            text = unescape(raw)
            parts.append(text)
            if links:
                linked += len("".join(text.split()))

    def close(number: int) -> None:
        nonlocal skipped, main, links
        tag, skip, is_main, frame = stack.pop(number)
        skipped -= skip
        main -= is_main
        links -= tag == "a"
        if frame >= 0:
            inside.remove(frame)

    def leave(to: int) -> None:
        while len(stack) > to:
            close(-1)

    while at < end:
        found = _TOKEN.search(html, at)
        if not found:
            say(html[at:])
            break
        say(html[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            if found[0].startswith("<![CDATA["):
                say(found[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if found[1]:
            if tag not in _INLINE:
                flush()
            opened = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if opened >= 0:
                if tag not in _INLINE or not any(x[0] not in _INLINE for x in stack[opened:]):
                    leave(opened)
                else:  # an inline element closed outside of the block it was opened in
                    close(opened)
            continue
        if tag not in _INLINE:
            flush()
        if tag in _DATA:
            shut = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.I).search(html, at)
            if not found[3].rstrip().endswith("/") or tag not in ("svg", "iframe"):
                at = shut.end() if shut else end
            continue
        if tag in _VOID or found[3].rstrip().endswith("/") and tag in _INLINE:
            continue
        if tag == "p" or tag in _CLOSED_BY:
            shuts = {"p"} if tag == "p" else _CLOSED_BY[tag]
            stop = {"p": {"article", "main", "div", "td", "th", "li", "section", "body", "blockquote"}}.get(tag, {"ul", "ol", "dl", "table", "select"})
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in shuts:
                    leave(i)
                    break
                if stack[i][0] in stop:
                    break
        is_main = tag in ("article", "main") and not skipped
        kind = _frame(tag, found[3], main > 0)
        has_name = kind in ("named", "weak") and not skipped
        if (kind == "hard" or has_name) and not skipped:
            flush()
        if has_name:
            inside.append(len(named))
            named.append((kind, main > 0))
        skipped += kind == "hard"
        main += is_main
        links += tag == "a"
        stack.append((tag, kind == "hard", is_main, len(named) - 1 if has_name else -1))
    flush()
    frames = _frames(lines, named)
    return [line[:3] for line in lines if not frames.intersection(line[3])]


def _length(text: str, linked: int) -> int:
    return max(0, len(text.replace(" ", "")) - linked)


def _frames(lines: list[tuple[str, int, bool, tuple[int, ...]]], named: list[tuple[str, bool]]) -> set[int]:
    """Which of the elements with telling names frame the page.

    Not one that holds half of the page's text, unless a story stands in an article
    beside it; and not one with a weak name that holds more than a short text.
    """
    if not named:
        return set()
    whole, articles = 0, 0
    held, told = [0] * len(named), [0] * len(named)  # text of each; of that, within an article or main element
    for text, linked, is_main, inside in lines:
        n = _length(text, linked)
        whole += n
        articles += n * is_main
        for k in inside:
            held[k] += n
            told[k] += n * is_main
    out = set()
    for k, (kind, within) in enumerate(named):
        most = 2 * held[k] >= whole and held[k] > SURGE and (within or articles - told[k] <= SURGE)
        if not (most or kind == "weak" and held[k] > SHORT):
            out.add(k)
    return out


def main_lines(lines: list[tuple[str, int, bool]], window: int = WINDOW, surge: int = SURGE) -> list[str]:
    """The lines between the surge and the dive of the distribution of text lengths.

    The block of line i is lines i to i + window - 1, without what is in links.  Text
    surges where a block exceeds ``surge``, and dives where blocks come down to nothing.
    Where the article or main elements hold half of the page's text or more, their lines
    alone are looked at, and ends are looser: see _inside.  Else, as with a teaser beside
    the story, the elements say nothing and all lines are looked at.  A line that is a
    link alone weighs nothing, and stays where the text on both sides of it does.
    """
    own = [_length(text, linked) for text, linked, _ in lines]
    marked = sum(n for n, line in zip(own, lines, strict=True) if line[2])
    if marked and 2 * marked >= sum(own):
        at = [i for i, line in enumerate(lines) if line[2]]
        return [lines[at[k]][0] for k in _inside([own[i] for i in at], window, surge)]
    stretches = [(first, last) for first, last, surges in _stretches(own, window, surge) if surges]
    if not stretches:
        return [text for (text, _, _), n in zip(lines, own, strict=True) if n > 0]
    return [lines[k][0] for first, last in stretches for k in range(first, last)]


def _stretches(own: list[int], window: int, surge: int, loose: bool = False) -> list[tuple[int, int, bool]]:
    """(first line, end, whether text surges) of what stands between dives; ``loose``: from the dive before, else from the short lines at the surge."""
    blocks = [sum(own[i : i + window]) for i in range(len(own))]
    out, i = [], 0
    while i < len(blocks):
        if blocks[i] > (0 if loose else surge):
            first, surges = i, False
            while i < len(blocks) and blocks[i] > 0:
                surges |= blocks[i] > surge
                i += 1
            last = i
            while first < last and own[first] == 0 and not (loose and first == 0):  # a linked heading
                first += 1
            while not loose and last > first and own[last - 1] == 0:
                last -= 1
            while not loose and first > 0 and own[first - 1] > 0:  # headings
                first -= 1
            out.append((first, last, surges))
        i += 1
    return out


def _inside(own: list[int], window: int, surge: int) -> list[int]:
    """Lines of an article to keep, given its lines' lengths.

    Every stretch that surges is kept from dive to dive, with short lines at its ends and
    single links within; so is the first, whose short lines are headings.  An article
    that never surges keeps all its stretches.
    """
    stretches = _stretches(own, window, surge, loose=True)
    any_surge = any(surges for _, _, surges in stretches)
    return [i for k, (first, last, surges) in enumerate(stretches) if surges or not any_surge or k == 0 for i in range(first, last)]


def main_text(html: str | None) -> str:
    return " ".join(main_lines(lines_of(html or "")))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``, and ``n_chars``, its code points.

    A null or empty page, and one without text, has an empty text.  Columns of those
    names are replaced; repeated rows are extracted each.
    """
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    own = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html}`").alias("__html"))
    at = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                texts = [main_text(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*part.schema.names[:at], "text", "n_chars"])

    return own.mapInArrow(trimmed(run), T.StructType([*own.schema.fields[:at], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
