"""Main text of HTML pages by line-block distribution.

A page becomes lines: one for each block of its markup, scripts, styles, comments and tags stripped. Each line weighs as much text
as it has outside links; lines of menus, headers, footers, sidebars, notices, adverts, forms and reader comments weigh nothing,
and so do lines outside the article if the page marks one. Summed over windows of WINDOW neighbouring lines the weights
rise where the main text begins (surge) and fall back to nothing behind it (dive); what lies between is kept, without the lines
that weigh nothing by their place. One page is one row, so the work needs no shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measurekit.llm.shared import by_bytes, fresh

WINDOW = 3
# Text a window must hold for a surge on pages that do not mark their article.
SURGE = 120

# Fixed values of HTML: elements that break lines, hold no text, or never close.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
SKIPPED = frozenset("script style noscript template svg math iframe object embed canvas audio video head title textarea select button datalist map noframes".split())
RAW = frozenset("script style textarea title iframe noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements and names that mark what is not the article.
ASIDE = frozenset("nav footer aside form menu dialog search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
ASIDE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promoted cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login sidebar side rail widget widgets nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar comment comments commentlist disqus respond replies reply feedback reviews related recommended share sharing social tags skip copyright disclaimer".split())
COMMENT_NAMES = frozenset("comment reply".split())
# Words that say where such a part stands, before its name, and what is in it, after its name. With any other word the name means
# something else: `has-sidebar`, `page-with-header`, `layout-sidebar-right`, `related-work`.
BEFORE_NAME = frozenset("app article blog bottom desktop div entry fixed global google inline js left main master mobile my page post primary reader right secondary site sticky story the top user web wp".split())
AFTER_NAME = frozenset("archive area articles bar block body bottom box button buttons card categories cell cloud container content desktop entries fixed form frame group holder icon icons inner item items label leaderboard left link links list main meta mobile outer panel pane placeholder post posts primary recent rectangle right row search secondary section slot space sticky stories strip text thread title to toggle top unit wrap wrapper".split())
TITLE_NAME = re.compile(r"(?:article|content|entry|page|post|story)[_-]header", re.I)
NAME_PART = re.compile(r"[\s_-]+")
NUMBER = re.compile(r"\d[\dx]*$")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
HREF = re.compile(r"(?:^|\s)href\s*=", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACES = re.compile(r"\s+")


def _names(value: str, wanted: frozenset[str]) -> bool:
    """Whether a whole token of a class or id is one of the names, with words before or after it that keep its meaning."""
    for token in value.lower().split():
        found = False
        for part in NAME_PART.split(TITLE_NAME.sub("", token).split("--")[0]):
            part = NUMBER.sub("", part)
            if part in wanted:
                found = True
            elif part and part not in (AFTER_NAME if found else BEFORE_NAME):
                break
        else:
            if found:
                return True
    return False


def _is_aside(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in ASIDE or tag == "header" and not in_article:
        return True
    if not attrs:
        return False
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "role" and value.lower() in ASIDE_ROLES or name == "aria-hidden" and value.lower() == "true" or name == "style" and HIDDEN.search(value):
            return True
        if name == "id" and (tag in HEADINGS or tag == "section" and in_article):   # made from a title
            continue
        if name in ("class", "id") and tag not in ("body", "html", "main") and _names(value, COMMENT_NAMES if tag == "article" else ASIDE_NAMES):
            return True
    return re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attrs, re.I) is not None


def page_lines(page: str, spared: frozenset[int] = frozenset()) -> tuple[list[tuple[str, int, bool]], bool, frozenset[int], frozenset[int]]:
    """Lines as (text, text outside links, in the article), in page order, those of no weight with empty text; whether an article is
    marked; and where the elements begin that are beside the article though `main`, or only an `article`, lies in them.

    spared: where elements begin that are not beside the article whatever they are called.
    """
    around_main: set[int] = set()
    around_article: set[int] = set()
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool, bool, int]] = []     # open elements: name, aside, skipped, article, where it begins
    aside = skipped = article = links = link_at = 0
    marked = False
    kept_aside = False

    def close_line() -> None:
        nonlocal linked, kept_aside
        if parts:
            text = SPACES.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                lines.append((text, max(0, len(text) - linked), article > 0))
            parts.clear()
        elif kept_aside:
            lines.append(("", 0, False))
        linked, kept_aside = 0, False

    def pop() -> None:
        nonlocal aside, skipped, article, links
        _, a, s, m, _ = stack.pop()
        aside, skipped, article = aside - a, skipped - s, article - m
        if len(stack) < link_at:                            # a link that was never closed ends with the element it began in
            links = 0

    at = 0
    while True:
        tag = TAG.search(page, at)
        text = page[at:tag.start() if tag else len(page)]
        if text and not skipped:
            if aside:
                kept_aside = kept_aside or not text.isspace()
            else:
                parts.append(text)
                linked += len(text) * (links > 0)
        if tag is None:
            break
        at = tag.end()
        name = tag[2].lower() if tag[2] else ""
        if not name:
            continue
        closing, attrs = tag[1], tag[3] or ""
        if name in BLOCKS:
            close_line()
        elif name == "br" and not aside and not skipped:
            parts.append(" ")
        if name == "a":                                     # without a target it is an anchor
            links, link_at = int(not closing and HREF.search(attrs) is not None), len(stack)
        if name in VOID:
            continue
        if closing:
            if any(x[0] == name for x in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name == "p" and stack and stack[-1][0] == "p" or name == "li" and stack and stack[-1][0] == "li":
            pop()
        if name in RAW:                                     # up to its own end tag, whatever tags it holds
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if attrs.rstrip().endswith("/") and name in ("svg", "path", "use"):
            continue
        beside = _is_aside(name, attrs, article > 0) and tag.start() not in spared
        if name in ("article", "main") and not beside and aside and not skipped:
            (around_main if name == "main" else around_article).update(x[4] for x in stack if x[1])
        entry = name, beside, name in SKIPPED, name in ("article", "main") and not beside and not aside and not skipped, tag.start()
        if name in ("article", "main") or aside or skipped or entry[1] or entry[2] or name in BLOCKS or name in ("header",):
            stack.append(entry)
            aside, skipped, article = aside + entry[1], skipped + entry[2], article + entry[3]
            marked = marked or entry[3]
    close_line()
    return lines, marked, frozenset(around_main), frozenset(around_article)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    lines, marked, around_main, around_article = page_lines(page)
    if around_main:                                         # what holds the main part is not beside it
        lines, marked, _, around_article = page_lines(page, around_main)
    text = _surge_to_dive(lines, marked)
    if around_article and not marked:                       # articles in such elements only: teasers, or the text of the page
        inside = _surge_to_dive(*page_lines(page, around_article)[:2])
        text = max(text, inside, key=len)
    return text


def _surge_to_dive(lines: list[tuple[str, int, bool]], marked: bool) -> str:
    weight = [0 if marked and not inside else len(text) if marked else own for text, own, inside in lines]
    surge = 1 if marked and any(weight) else SURGE
    if marked and not any(weight):
        weight = [own for _, own, _ in lines]
    sums = [sum(weight[i:i + WINDOW]) for i in range(len(lines))]
    if surge > 1 and sums and max(sums) < surge:            # a short page: any text is a surge
        surge = 1
    kept, i = [], 0
    while i < len(lines):
        if sums[i] < surge:
            i += 1
            continue
        while i and weight[i - 1] and (not kept or kept[-1] != i - 1):  # a heading before the surge
            i -= 1
        while i < len(lines) and sums[i] > 0:               # from the surge to the dive
            if weight[i]:
                kept.append(i)
            i += 1
    return "\n\n".join(lines[i][0] for i in kept)


def extract_main_text(pages: DataFrame, *, page: str = "html") -> DataFrame:
    """Adds text and n_chars (code points), under names no column of pages has, to its rows.

    A null or empty page, and one without main text, gives an empty text. Text between tags that are never closed, and a page
    that ends in the middle of a tag, are read as browsers do; pages of any length are read whole.
    """
    names = fresh(pages, "text", "n_chars")
    column = pages.columns.index(page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, page_name, 1 << 22):
            texts = [main_text(p) for p in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names, *names])

    page_name = pages.columns[column]
    return pages.mapInArrow(run, pages.select("*", F.lit("").alias(names[0]), F.lit(0).cast("long").alias(names[1])).schema)


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    out = extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return out.drop("html")
