"""Main text of web pages by tag-path ratios.

Every block of text has a tag path, the block elements from the root down to it. Text length and punctuation are
summed per path and divided by the path's blocks; the two ratios are fused, smoothed along the page, and paths over a
threshold are content. What names itself as navigation, notice, advert, form or comment has no weight. Short blocks
(headings, list items) count as content where they stand in the container that holds most of the selected text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMOOTHING = (0.25, 0.5, 0.25)  # weights of the block before, the block and the block after
THRESHOLD = 0.5  # of the standard deviation of the smoothed scores
LINKED = 0.5  # share of a path's text in links beyond which it is a menu

# Elements that neither break a block nor belong to its path.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
                   "time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp svg math object".split())
OUTSIDE = frozenset("nav footer aside form menu dialog button select option fieldset legend audio video canvas head".split())
SHORT = frozenset("h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption td th caption".split())
# An open element of the first kind ends where one of these begins.
ENDS = {"p": None, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
        "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
SCOPES = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]),
          "th": frozenset(["table"]), "option": frozenset(["select"])}

# Words by which classes, ids and roles name what is not the article.
ASIDE = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adbox|adslot|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumb\w*|side-?bar\w*|widget\w*|footer\w*|site-?header|page-?header|"
    r"header|masthead|top-?bar|cookie\w*|consent\w*|gdpr|notice\w*|alert\w*|popup\w*|pop-up|modal\w*|overlay\w*|subscri\w*|newsletter\w*|sign-?up|log-?in|"
    r"social\w*|share\w*|sharing|follow|related\w*|recommend\w*|trending|popular|most-?read|comment\w*|disqus|respon[ds]\w*|repl(?:y|ies)|discussion|"
    r"tags|tag-?(?:list|cloud)|pagination|pager|search\w*|copyright|legal|disclaimer|skip|hidden|screen-?reader\w*)(?:$|[^a-z])", re.I)

# Words about the layout around an article, or its own head, that say nothing of the element they stand on.
LAYOUT = re.compile(r"(?:has|with|no|without)-[a-z]+|(?:article|entry|post|content|story|section)-header", re.I)

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:_-]*))")
_QUOTE_OR_END = re.compile(r"[\"'>]")
_NAME = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")


@dataclass
class BlockText:
    path: tuple[str, ...]
    aside: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _named(tag: str, attributes: str) -> tuple[str, bool]:
    """(path step, whether it names itself as something beside the article)."""
    if not attributes or attributes.isspace():
        return tag, tag in OUTSIDE
    names, aside = [], tag in OUTSIDE
    for key, value in _NAME.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            names.append(value)
            aside = aside or tag not in ("html", "body", "article", "main") and bool(ASIDE.search(LAYOUT.sub("", value)))
        elif key == "role":
            aside = aside or value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog")
        elif key == "style":
            aside = aside or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        else:
            aside = aside or key == "hidden" or value.lower() == "true"
    return ".".join([tag, *names]), aside


class Tags:
    """Tags of a page in order. What is looked for and not found before the end is not looked for again, so a page is
    passed once however broken it is."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.quoted, self.unclosed = page, page.rfind(">"), True, set()

    def end(self, at: int) -> int:
        """Where a tag's attributes that begin here end: at the first ">" outside quotes; -1 if there is none at all."""
        if at > self.last:
            return -1
        start = at
        while self.quoted:
            stop = _QUOTE_OR_END.search(self.page, at)
            if stop is None:
                break
            if stop[0] == ">":
                return stop.start()
            close = self.page.find(stop[0], stop.end())
            if close < 0:
                break
            at = close + 1
        # A quote stays open to the end of the page: from here on quotes count for nothing.
        self.quoted = False
        return self.page.find(">", start)

    def closing(self, tag: str, at: int) -> int:
        """Behind the closing tag of a raw element; -1 if there is none."""
        if tag in self.unclosed:
            return -1
        found = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(self.page, at)
        if found is None:
            self.unclosed.add(tag)
            return -1
        close = self.page.find(">", found.start())
        return len(self.page) if close < 0 else close + 1


def blocks(page: str) -> list[BlockText]:
    """Text blocks of a page in order, with their tag paths; comments, scripts and the like are left out."""
    out: list[BlockText] = []
    stack: list[tuple[str, str, bool]] = []  # tag, path step, beside the article
    links, open_block, at, tags, depth = 0, None, 0, Tags(page), Counter()

    def add(text: str) -> None:
        nonlocal open_block
        if not text:
            return
        if open_block is None:
            if text.isspace():
                return
            open_block = BlockText(tuple(s for _, s, _ in stack), any(a for _, _, a in stack))
            out.append(open_block)
        open_block.parts.append(text)
        if links:
            open_block.linked += len(text.strip())

    n = len(page)
    while at < n:
        match = _OPEN.search(page, at)
        if match is None:
            add(page[at:])
            break
        stop = tags.end(match.end()) if match[2] else 0
        if stop < 0:
            # No tag closes from here on.
            add(page[at:match.end()])
            at = match.end()
            continue
        add(page[at:match.start()])
        at = match.end()
        if match[0] == "<!--":
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        if not match[2]:
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        closing, tag, attributes, at = match[1], match[2].lower(), page[at:stop], stop + 1
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if closing else links + 1
            continue
        if tag == "br":
            if open_block is not None:
                open_block.parts.append(" ")
            continue
        if not closing and tag in RAW:
            end = tags.closing(tag, at)
            if end < 0 and tag in ("script", "style"):
                break
            at = max(at, end)
            continue
        if tag in VOID:
            open_block = None if tag == "hr" else open_block
            continue
        open_block = None
        if closing:
            if depth[tag]:
                while True:
                    name = stack.pop()[0]
                    depth[name] -= 1
                    if name == tag:
                        break
            links = 0
            continue
        if tag not in RAW:
            for k in range(len(stack) - 1, -1, -1):
                name = stack[k][0]
                if name == "p" or name in ENDS and tag in (ENDS[name] or ()):
                    depth.subtract(s for s, _, _ in stack[k:])
                    del stack[k:]
                    break
                if tag in SCOPES and name in SCOPES[tag] or name not in ENDS:
                    break
        links = 0
        if not attributes.endswith("/"):
            step, aside = _named(tag, attributes)
            if tag == "header" and not any(t in ("article", "main") for t, _, _ in stack):
                aside = True
            stack.append((tag, step, aside))
            depth[tag] += 1
    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
    return [b for b in out if b.text]


def main_text(page: str | None) -> str:
    """The article's blocks, one a line; '' for null or empty pages and pages with nothing but what is beside an article."""
    if not page:
        return ""
    every = blocks(page)
    # Where names alone would leave nothing, they are not believed: the ratios decide over all but the elements that stand aside.
    found = [b for b in every if not b.aside] or [b for b in every if not any(step.split(".")[0] in OUTSIDE for step in b.path)]
    if not found:
        return ""
    length: dict[tuple, int] = {}
    marks: dict[tuple, int] = {}
    count: dict[tuple, int] = {}
    linked: dict[tuple, int] = {}
    for b in found:
        length[b.path] = length.get(b.path, 0) + len(b.text)
        marks[b.path] = marks.get(b.path, 0) + len(_PUNCTUATION.findall(b.text))
        count[b.path] = count.get(b.path, 0) + 1
        linked[b.path] = linked.get(b.path, 0) + b.linked
    # Both ratios of a path fused, in logarithms so that one long block does not drown the others; menus weigh nothing.
    score = {p: 0.0 if linked[p] > LINKED * length[p] else math.log1p(length[p] / count[p]) * (1 + math.log1p(marks[p] / count[p])) for p in length}
    raw = [score[b.path] for b in found]
    smooth = []
    for k, value in enumerate(raw):
        around = [(w, raw[j]) for w, j in zip(SMOOTHING, (k - 1, k, k + 1)) if 0 <= j < len(raw)]
        smooth.append(sum(w * v for w, v in around) / sum(w for w, _ in around) if value else 0.0)
    by_path: dict[tuple, list[float]] = {}
    for b, value in zip(found, smooth):
        by_path.setdefault(b.path, []).append(value)
    level = {p: sum(v) / len(v) for p, v in by_path.items()}
    mean = sum(smooth) / len(smooth)
    spread = math.sqrt(sum((v - mean) ** 2 for v in smooth) / len(smooth))
    bar = THRESHOLD * spread if spread else 0.0
    chosen = {p for p, v in level.items() if v > 0 and v >= bar}
    if not chosen:
        return ""
    container = _container(chosen, length, score)
    keep = []
    for b in found:
        inside = b.path[:len(container)] == container
        short = b.path and b.path[-1].split(".")[0] in SHORT
        if inside and (b.path in chosen or short and linked[b.path] <= LINKED * length[b.path]):
            keep.append(b.text)
    return "\n".join(keep)


def _container(chosen: set[tuple], length: dict[tuple, int], score: dict[tuple, float]) -> tuple:
    """The deepest path below which lies most of the selected text; an article or main element is one at once."""
    weight = {p: length[p] * score[p] for p in chosen}
    total, here = sum(weight.values()), ()
    while True:
        if here and here[-1].split(".")[0] in ("article", "main") and not any(p[len(here)].split(".")[0] == "article" for p in chosen if p[:len(here)] == here and len(p) > len(here)):
            return here
        below: dict[str, float] = {}
        for p, w in weight.items():
            if p[:len(here)] == here and len(p) > len(here):
                below[p[len(here)]] = below.get(p[len(here)], 0) + w
        best = max(below, key=lambda s: (below[s], s), default=None)
        # The last step of a path is the block itself, not a container.
        if best is None or below[best] < 0.75 * total or not any(len(p) > len(here) + 1 and p[:len(here) + 1] == (*here, best) for p in chosen):
            return here
        here = (*here, best)


def extract(pages: DataFrame, page_id: str = "page_id", page: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: the id, the columns to keep, and text. Null or empty pages have empty text; repeated rows each have theirs."""
    kept = [page_id, *keep]
    schema = pages.select(*kept).schema.add("text", "string")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = pa.array([main_text(x.as_py()) for x in part.column(len(kept))], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], texts], [*kept, "text"])

    return pages.select(*kept, F.col(page).cast("string").alias("__html")).mapInArrow(run, schema)
