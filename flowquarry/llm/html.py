"""Main text of web pages by line-block distribution.

Method. Markup is stripped into lines: every border of a block element ends a line, so that borders
between blocks leave empty lines. Menus, headers, footers, sidebars, notices, adverts, forms, comments,
scripts and styles count as markup. Text lengths are summed over sliding windows of `WINDOW` lines. A surge
point is where the sum rises from nothing, a dive point where it falls back to nothing; the text between them
is a stretch. Dense stretches are those whose largest sum is at least `SHARE` of the page's largest. The region
goes from the first dense stretch's surge to the last one's dive; thin stretches next to it that are all paragraphs of sentences belong to it, and it
starts at the nearest h1 (h2, if there is none) before it; every stretch between is kept, however short, and nothing in the region is
dropped. Ends that may be left out (p, li, dd, dt, td, th, tr, option) are filled in.

An article element (main, where there is none) is a prior: where its text is no less than that of the region that line
blocks find outside it, its lines weigh `PRIOR` times as much in the sums, all of them are kept, and of the lines
outside it those of dense stretches. Elsewhere, as with teasers beside a body, it has no weight.

A page is read in one pass of its tags, in time proportional to its length, whatever is left unclosed in it. A null
page or a page without text gives an empty text. Rows never meet: repeated rows each get their own result, and
extra columns of the input are ignored.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
SHARE = 0.2
PRIOR = 20

#: Elements that hold no article text, inline elements, and words of class, id or role that mark other page parts.
DROPPED = frozenset("head script style noscript template svg math iframe object canvas nav footer aside form button select textarea dialog menu audio video map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
#: Elements whose end may be left out, and those whose start ends them.
_CELLS = frozenset("td th tr tbody tfoot".split())
ENDS_WITH = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt td th tr".split()),
    "li": frozenset({"li"}), "dd": frozenset({"dd", "dt"}), "dt": frozenset({"dd", "dt"}), "option": frozenset({"option", "optgroup"}),
    "td": _CELLS, "th": _CELLS, "tr": frozenset({"tr", "tbody", "tfoot"}),
}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OTHER_PARTS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login "
    "menu modal nav navbar navigation newsletter notice notification notifications popup promo promoted promotion related replies reply share sharing "
    "sidebar sidenav signup skip social sponsor sponsored subscribe subscription toolbar widget widgets alert search contentinfo complementary".split()
)
COMMENT_PARTS = frozenset("comment comments disqus replies reply".split())
#: Endings that make one word with the name of a part, as in commentlist.
ENDINGS = frozenset("s list lists box area wrap wrapper container section block form bar item items unit slot panel inner holder group feed thread row".split())
MAIN_PARTS = frozenset("article body content entry main page post story text".split())

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
UNQUOTED = re.compile(r"[^\"'>]*")
#: Elements whose content is no markup, and their ends.
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title")}
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)")


def _part_words(attributes: str) -> set[str] | None:
    """Words of an element's class, id and role; None if it is hidden."""
    words: set[str] = set()
    for key, x, y, z, bare in ATTRIBUTE.findall(attributes):
        key = (key or bare).lower()
        value = (x or y or z).lower()
        if key in ("class", "id", "role", "aria-label"):
            words.update(re.split(r"[^a-z0-9]+", value))
        elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value):
            return None
    return words


def _named(words: set[str], parts: frozenset[str]) -> bool:
    """Whether a word names one of the parts, alone or with an ending; names of under 6 letters only alone."""
    return bool(words & parts) or any(w[:n] in parts and w[n:] in ENDINGS for w in words for n in range(6, len(w)))


def _is_other(name: str, attributes: str, depth: int) -> tuple[bool, bool]:
    """Whether an element is no part of the article, and whether it holds comments."""
    if name in ("html", "body", "main"):
        return False, False
    words = _part_words(attributes) if attributes else set()
    comments = bool(words and _named(words, COMMENT_PARTS))
    if name == "article":  # a reader's comment may be an article inside the article
        return comments and depth > 0, comments
    if name in DROPPED or name == "header" or words is None:
        return True, comments
    return _named(words, OTHER_PARTS) and not words & MAIN_PARTS, comments


def _holds_article(name: str, mains: int, held: int, titles: int, articles: int, depth: int) -> bool:
    """Whether an element that looks like another part wraps the article itself, or its title."""
    if mains or articles and held == articles:
        return True
    return titles > 0 and (name == "header" and depth > 0 or name not in DROPPED and name != "header" and not articles or name == "form")


def _tag_end(page: str, at: int) -> int | None:
    """The place after the > that ends a tag, which is not one between quotes; a quote that no other follows is none."""
    while (at := UNQUOTED.match(page, at).end()) < len(page):
        if page[at] == ">":
            return at + 1
        at = max(at, page.find(page[at], at + 1)) + 1
    return None


def _tags(page: str) -> list[tuple[int, int, str, bool, str]]:
    """Start, end, name, whether it closes, attributes; what scripts and styles hold is passed over."""
    out, at, last, quoted, open_ended = [], 0, page.rfind(">"), True, set()
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            out.append((start, at, "", False, ""))
            continue
        if start > last:  # only an unclosed comment may follow
            at = page.find("<!--", start)
            if at < 0:
                break
            continue
        if page.startswith("<![CDATA[", start) and "<![CDATA[" not in open_ended:
            end = page.find("]]>", start)
            if end >= 0:
                out.append((start, at := end + 3, "", False, ""))
                continue
            open_ended.add("<![CDATA[")
        if page[start + 1] in "!?":
            at = page.find(">", start) + 1
            out.append((start, at, "", False, ""))
            continue
        m = NAME.match(page, start)
        if not m:
            at = start + 1
            continue
        stop = _tag_end(page, m.end()) if quoted else None
        if stop is None:  # quotes do not pair up to the page's end, so they are plain characters from here on
            quoted, stop = False, page.find(">", m.end()) + 1
        name, at = m[2].lower(), stop
        out.append((start, stop, name, bool(m[1]), page[m.end() : stop - 1]))
        if name in RAW and not m[1] and name not in open_ended:
            if end := RAW[name].search(page, at):
                out.append((end.start(), end.end(), name, True, ""))
                at = end.end()
            else:
                open_ended.add(name)
    return out


def _partners(tags: list) -> tuple[list[int | None], list[int | None]]:
    """The tag that closes each element, and the tag before which it ends where its own end may be left out and is."""
    opened: dict[str, list[int]] = {}
    out: list[int | None] = [None] * len(tags)
    for j, (_, _, name, closes, _) in enumerate(tags):
        if not closes:
            opened.setdefault(name, []).append(j)
        elif opened.get(name):
            out[opened[name].pop()] = j
    implied: list[int | None] = [None] * len(tags)
    waiting: list[int] = []  # open elements of this kind, an end of one that holds others ends them too
    for j, (_, _, name, closes, _) in enumerate(tags):
        if not name or name in INLINE or name in VOID and name != "hr":
            continue
        while waiting:
            last = waiting[-1]
            own = tags[last][2]
            if closes and name == own:
                waiting.pop()
            elif (name in ENDS_WITH[own]) if not closes else out[last] is None and name not in ENDS_WITH:
                implied[waiting.pop()] = j
                continue
            break
        if not closes and name in ENDS_WITH:
            waiting.append(j)
    return out, [i if x is None else None for i, x in zip(implied, out)]


def _upto(tags: list, name: str) -> list[int]:
    """How many elements of this name open before each tag."""
    return list(itertools.accumulate((t[2] == name and not t[3] for t in tags), initial=0))


#: What a line may lie in besides.
TITLE, HEADING, PARAGRAPH = 1, 2, 4
#: Words that end as a sentence does.
SENTENCE = re.compile(r"\S\s.*[.!?…。:;][\"'”’»)\]]*$", re.S)
KINDS = {"h1": TITLE, "h2": HEADING, "p": PARAGRAPH}


def lines(page: str) -> tuple[list[str], list[bool], list[int]]:
    """The page's lines, which of them lie in an article element, and which in an h1, an h2 or a paragraph of sentences."""
    tags = _tags(page)
    partner, implied = _partners(tags)
    opens = [_upto(tags, name) for name in ("main", "article", "h1")]
    articles = opens[1][-1]
    holder = "article" if articles else "main"
    out, inside, kinds, buffer, depth, kind, at, i = [], [], [], [], 0, 0, 0, 0

    def end_line() -> None:
        text = " ".join(html.unescape("".join(buffer)).split())
        out.append(text)
        inside.append(depth > 0)
        kinds.append(kind if kind != PARAGRAPH or SENTENCE.search(text) else 0)
        buffer.clear()

    while i < len(tags):
        start, stop, name, closes, attributes = tags[i]
        buffer.append(page[at:start])
        at = stop
        if not closes and name and name not in VOID:
            other, comments = _is_other(name, attributes, depth)
            j = partner[i] if other else None
            if other and implied[i] is not None:
                end_line()
                end_line()
                at, i = tags[implied[i]][0], implied[i]
                continue
            if j is not None:
                if comments or not _holds_article(name, *(n[j] - n[i + 1] for n in opens), articles, depth):
                    if name not in INLINE:
                        end_line()
                        end_line()
                    at, i = tags[j][1], j + 1
                    continue
        if name == "br":
            buffer.append(" ")
        elif name and name not in INLINE:
            end_line()
        if name == holder:
            depth = max(0, depth + (-1 if closes else 1))
        if name and name not in INLINE:
            kind = 0 if closes else KINDS.get(name, 0)
        i += 1
    buffer.append(page[at:])
    end_line()
    return out, inside, kinds


def _stretches(size: list[int]) -> list[tuple[int, int, bool]]:
    """From each surge to its dive, and whether the stretch between is dense."""
    total = list(itertools.accumulate(size, initial=0))
    sums = [total[min(i + WINDOW, len(size))] - total[i] for i in range(len(size))]
    out, start = [], None
    for i, s in enumerate([*sums, 0]):
        if s and start is None:
            start = i  # surge
        elif not s and start is not None:
            out.append((start, i, max(sums[start:i])))  # dive
            start = None
    least = SHARE * max((m for _, _, m in out), default=0)
    return [(a, b, m >= least) for a, b, m in out]


def _region(stretches: list[tuple[int, int, bool]], size: list[int], kinds: list[int]) -> tuple[int, int]:
    """The lines from the first surge to the last dive of the dense stretches, with the title before them and the thin stretches of paragraphs beside them."""
    dense = [i for i, (_, _, d) in enumerate(stretches) if d]
    if not dense:
        return 0, 0
    first, last = dense[0], dense[-1]

    def paragraphs(i: int) -> bool:
        a, b, _ = stretches[i]
        return all(kinds[k] & PARAGRAPH for k in range(a, b) if size[k])

    while first and paragraphs(first - 1):
        first -= 1
    while last + 1 < len(stretches) and paragraphs(last + 1):
        last += 1
    a, b = stretches[first][0], stretches[last][1]
    for kind in (TITLE, HEADING):
        before = [i for i in range(a) if kinds[i] & kind and size[i]]
        if before:
            return before[-1], b
    return a, b


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found, inside, kinds = lines(page)
    size = [len(x) for x in found]
    outside = [0 if y else n for n, y in zip(size, inside)]
    a, b = _region(_stretches(outside), outside, kinds)
    within = sum(size) - sum(outside)
    if within and sum(outside[a:b]) <= within:
        dense = [d for d in _stretches([n * (PRIOR if y else 1) for n, y in zip(size, inside)]) if d[2]]
        keep = inside[:]
        for x, y, _ in dense:
            keep[x:y] = [True] * (y - x)
    else:
        a, b = _region(_stretches(size), size, kinds)
        keep = [a <= k < b for k in range(len(size))]
    return " ".join(x for x, k in zip(found, keep) if k and x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text and n_chars (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    rows = pages.select(pages[id_col].cast("long").alias(id_col), pages[url_col].cast("string").alias(url_col), pages[html_col].cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")
