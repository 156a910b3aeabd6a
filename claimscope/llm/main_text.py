"""Main text of HTML pages by two-pass block rules.

The page is cut into blocks at block-level tags. Pass 1 decides blocks by what they stand in (menus, footers, adverts, forms), by the share of
their characters in links, by their length and by the share of stop words. Short blocks and middling ones stay ambiguous.
In pass 2 they take the label of the nearest decided neighbour; a tie goes to the text if the block itself has stop words. Inside an
article element only blocks of that element are neighbours, and if none of them is decided the ambiguous ones are text.

Menus, footers, asides and hidden elements hold no text. A form or a class name that sounds like boilerplate is a vote only:
it counts for nothing around the article or main element, around most of the text that pass 1 would decide without it, or
if such elements hold all of that text. Comments are text only on a page that has no other. On a page in another language its own most frequent short words
stand in for stop words. If no block of a page is text by itself, all ambiguous ones are.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm.common import bounded_batches, load

#: Characters below which a block is short, and from which one rich in stop words is text by itself.
SHORT, LONG = 70, 200
#: Shares: links above which a block is no text; stop words from which it is text, or may be.
LINKS, STOPS_HIGH, STOPS_LOW = 0.5, 0.25, 0.1
#: On a page with few known stop words, so many of its most frequent words of so many letters are taken for them.
OWN_WORDS, OWN_LETTERS = 30, 4

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """the and of to in a is it that for on with as was be by are this from or an at not but have has
    le la les de des du et un une que qui en dans pour par sur est avec au aux ne pas se ce il elle
    der die das und in den von zu mit ist im ein eine nicht auf für als auch es an dem sich
    el los las del y que se por con para su al lo como más una no""".split()
)
# HTML element names by their role.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
DROPPED = frozenset("script style noscript template svg textarea select datalist button iframe canvas title option video audio annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav footer aside menu dialog".split())
FORMS = frozenset("form fieldset".split())
HINTS = frozenset(
    """ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer login
    masthead menu modal nav navbar navigation newsletter notice popup promo promotion related replies respond search share sharing sidebar
    signup skip social sponsor sponsored subscribe toolbar widget""".split()
)
#: Hints of what readers wrote. It may be longer than the text, and its parts may be article elements.
COMMENTS = frozenset("comment comments disqus replies respond".split())
#: How many times the text of the page's articles a doubtful element beside them must hold to be text too.
BESIDE = 4

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[/!?a-zA-Z](?:\"[^\"<]*\"|'[^'<]*'|[^'\">])*+>|<[/!?a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
# The bodies of these are no markup; they run to their own end tag.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I | re.A) for name in "script style textarea title noscript iframe".split()}
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
# Characters of scripts that put no blanks between words, and their sentence marks.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_SENTENCE = re.compile(r"[\u3001\u3002\uff01\uff0c\uff1f\u104a\u104b\u17d4]|[\u0e00-\u0eff]{40}")


@dataclass
class Block:
    text: str
    linked: int
    bad: bool
    article: int
    heading: bool
    #: The innermost doubtful element around it, 0 for none.
    within: int = 0


@dataclass
class Doubtful:
    """A form, or an element with a hint in its attributes; one of a larger number may be inside one of a smaller."""

    within: int
    comments: bool
    inside: bool = False
    rich: int = 0
    mains: int = 0
    articles: int = 0
    bad: bool = False


def _boilerplate(name: str, tag: str, in_article: bool) -> bool:
    """Whether an element holds no main text whatever is in it, by its name and its attributes."""
    if name in BOILERPLATE or (name == "header" and not in_article):
        return True
    if name in ("html", "body", "article", "main") or tag.find("=") < 0 and " hidden" not in tag:
        return False
    for key, value in _ATTRIBUTE.findall(tag):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key == "role" and value in ("banner", "contentinfo", "complementary", "navigation"):
            return True
    return False


def _hints(name: str, tag: str) -> set[str]:
    """Words in the attributes of an element that speak against main text."""
    if name in ("html", "body", "article", "main") or tag.find("=") < 0:
        return set()
    values = [v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(tag) if k.lower() in ("class", "id", "role")]
    return {word for v in values for word in HINTS.intersection(re.split(r"[^a-z0-9]+", v))}


def _tokens(page: str) -> Iterator[str]:
    """Tags, comments and texts of a page without the bodies of raw-text elements."""
    at = 0
    while at < len(page):
        for found in _TOKEN.finditer(page, at):
            yield found[0]
            at = found.end()
            name = _NAME.match(found[0])
            raw = _RAW.get(name[1].lower()) if name and found[0][1] != "/" and not found[0].endswith("/>") else None
            if raw:
                end = raw.search(page, at)
                at = end.start() if end else len(page)
                break


def _ends(tokens: list[str]) -> dict[int, int]:
    """Positions of the dropped elements that have an end tag of their own, and of those end tags.

    An open one ends without it where a block or a dropped element around it ends.
    """
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    depth = dict.fromkeys(BLOCKS | DROPPED, 0)
    for n, token in enumerate(tokens):
        match = _NAME.match(token)
        name = match[1].lower() if match else ""
        if name not in depth or name in VOID:
            continue
        if token[1] != "/":
            if name in BLOCKS or not token.endswith("/>"):
                stack.append((name, n))
                depth[name] += 1
        elif depth[name]:
            while True:
                last, at = stack.pop()
                depth[last] -= 1
                if last == name:
                    break
            if name in DROPPED:
                ends[at] = n
    return ends


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, empty ones left out. A dropped element without an end tag ends where the next block starts or ends."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    #: Open elements, each with what held before it; where in it the blocks and the elements of each name are.
    stack: list[tuple[str, bool, int, bool, bool, int]] = []
    open_blocks: list[int] = []
    open_names: dict[str, list[int]] = {}
    bad, article, link, heading, within = False, 0, False, False, 0
    doubtful = [Doubtful(0, False)]
    articles = 0
    tokens = list(_tokens(page))
    ends = _ends(tokens)
    #: Up to which token all is dropped, and whether all is until the next block.
    until, skip = -1, False

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, linked, bad, article, heading, within))
        parts.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal bad, article, link, heading, within
        _, bad, article, link, heading, within = stack[to]
        while len(stack) > to:
            open_names[stack.pop()[0]].pop()
        while open_blocks and open_blocks[-1] >= to:
            open_blocks.pop()

    for n, token in enumerate(tokens):
        if n <= until:
            continue
        if token[0] != "<" or len(token) == 1:
            if not skip:
                text = html.unescape(token)
                parts.append(text)
                if link:
                    linked += len("".join(text.split()))
            continue
        match = _NAME.match(token)
        if not match:
            continue
        name, closing = match[1].lower(), token[1] == "/"
        if skip and name not in BLOCKS:
            continue
        skip = False
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if closing:
            at = open_names[name][-1] if open_names.get(name) else None
            # An inline end tag does not close the block it is misplaced in.
            if at is not None and (name in BLOCKS or not open_blocks or open_blocks[-1] <= at):
                pop(at)
            continue
        if name in DROPPED:
            if n in ends:
                until = ends[n]
            elif not token.endswith("/>"):
                skip = True
            continue
        if name in VOID or (token.endswith("/>") and name not in BLOCKS):
            continue
        if name in BLOCKS:
            # A paragraph ends where the next block starts, and takes its open inline tags along.
            at = open_blocks[-1] if open_blocks else None
            if at is not None and (stack[at][0] == "p" or (stack[at][0] == name and name in ("li", "dt", "dd", "td", "th", "tr"))):
                pop(at)
        if name in BLOCKS:
            open_blocks.append(len(stack))
        open_names.setdefault(name, []).append(len(stack))
        stack.append((name, bad, article, link, heading, within))
        bad = bad or _boilerplate(name, token, article > 0)
        hints = set() if bad else _hints(name, token)
        if not bad and (hints or name in FORMS):
            doubtful.append(Doubtful(within, doubtful[within].comments or bool(hints & COMMENTS), article > 0))
            within = len(doubtful) - 1
        if name in ("article", "main"):
            if not article:
                articles += 1
                article = articles
                if not bad and not doubtful[within].comments:
                    doubtful[within].articles += name == "article"
                    doubtful[within].mains += name == "main"
        link = link or name == "a"
        heading = heading or (name[0] == "h" and name[1:].isdigit())
    flush()
    _weigh(out, doubtful)
    return out


def _weigh(blocks: list[Block], doubtful: list[Doubtful]) -> None:
    """Make the blocks bad whose doubtful elements stay so, by what these hold of the page."""
    if len(doubtful) == 1:
        return
    rich = [len(b.text) if _decided(b) else 0 for b in blocks]
    told = [0] * len(doubtful)
    for block, size in zip(blocks, rich, strict=True):
        doubtful[block.within].rich += size
        told[block.within] += len(block.text) if block.article and not block.bad else 0
    page = doubtful[0]
    for one in doubtful[:0:-1]:
        outer = doubtful[one.within]
        outer.rich, outer.mains, outer.articles = outer.rich + one.rich, outer.mains + one.mains, outer.articles + one.articles
    clear = told[0]
    for one, own in zip(doubtful[1:], told[1:], strict=True):
        if one.comments:
            text = one.rich and one.rich == page.rich and not page.mains + page.articles
        elif page.mains and one.mains == page.mains:
            text = True
        else:
            around = not page.mains and page.articles and one.articles == page.articles
            text = 2 * one.rich > page.rich and one.rich > (1 if one.inside else BESIDE) * clear or (around and 2 * one.rich >= page.rich)
        one.bad = doubtful[one.within].bad or not text
        clear += 0 if one.bad else own
    if not clear and all(doubtful[b.within].bad for b, size in zip(blocks, rich, strict=True) if size):
        for one in doubtful[1:]:
            one.bad = one.comments
    for block in blocks:
        block.bad = block.bad or doubtful[block.within].bad


def _own_words(blocks: list[Block]) -> frozenset[str]:
    """What stands in for stop words on a page in another language: its most frequent short words; none where the known ones are frequent."""
    counts: Counter[str] = Counter()
    for block in blocks:
        if len(block.text) >= SHORT and not block.bad and block.linked <= LINKS * len(block.text):
            counts.update(_WORD.findall(block.text.lower()))
    total = sum(counts.values())
    if not total or sum(n for w, n in counts.items() if w in STOP_WORDS) >= STOPS_HIGH * total:
        return frozenset()
    short = sorted((-n, w) for w, n in counts.items() if len(w) <= OWN_LETTERS and n > 1)
    return frozenset(w for _, w in short[:OWN_WORDS])


def _decided(block: Block, own: frozenset[str] = frozenset()) -> bool | None:
    """Pass 1: text, no text, or not decided."""
    size = len(block.text.replace(" ", ""))
    if block.bad or block.linked > LINKS * size:
        return False
    unspaced = len(_UNSPACED.findall(block.text))
    if 2 * unspaced > size:
        # Scripts without blanks say more in a character, and have sentence marks instead of stop words.
        return True if size >= SHORT // 3 and _SENTENCE.search(block.text) else None
    if len(block.text) < SHORT:
        return None
    if not block.article and block.linked > 0.3 * size:
        return False
    words = _WORD.findall(block.text.lower())
    stops = sum(w in STOP_WORDS or w in own for w in words) / max(len(words), 1)
    if stops >= STOPS_HIGH or (len(block.text) >= LONG and stops >= STOPS_LOW):
        return True
    return None


def _has_stops(block: Block) -> bool:
    return _SENTENCE.search(block.text) is not None or any(w in STOP_WORDS for w in _WORD.findall(block.text.lower()))


def _first_pass(blocks: list[Block]) -> list[bool | None]:
    own = _own_words(blocks)
    labels = [_decided(b, own) for b in blocks]
    # A copyright line is no text where no text follows it.
    for n in range(len(blocks) - 1, -1, -1):
        if "\xa9" in blocks[n].text and len(blocks[n].text) < LONG and not blocks[n].article:
            labels[n] = False
        elif labels[n]:
            break
    # A paragraph that is one link counts as text right between two paragraphs of text.
    for n in range(1, len(blocks) - 1):
        block = blocks[n]
        if labels[n] is False and not block.bad and len(block.text) >= SHORT and labels[n - 1] and labels[n + 1] and "\xa9" not in block.text:
            labels[n] = True
    if not any(labels) and not any(b.article and not b.bad for b in blocks):
        # Nothing is text by itself: a page of short paragraphs, verses or in a language unknown here.
        labels = [_WORD.search(b.text) is not None if label is None else label for b, label in zip(blocks, labels, strict=True)]
    return labels


def keep_blocks(blocks: list[Block]) -> list[str]:
    """Texts of the blocks that both passes keep."""
    labels = _first_pass(blocks)
    far = len(blocks) + 1
    nearest: list[list[tuple[int, bool]]] = [[] for _ in blocks]
    for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        last: dict[int, tuple[int, bool]] = {}
        for n in order:
            area = blocks[n].article
            if labels[n] is None:
                at, label = last.get(area, (far + n, False))
                nearest[n].append((abs(n - at), label))
            elif not (area and blocks[n].bad):
                last[area] = (n, labels[n])
    out = []
    for block, label, sides in zip(blocks, labels, nearest, strict=True):
        if label is None:
            (before, first), (after, second) = sides
            if min(before, after) >= far - 1 and block.article:
                label = True
            elif first == second:
                label = first
            elif before != after:
                label = first if before < after else second
            else:
                label = _has_stops(block)
        if label:
            out.append(block.text)
    return out


def main_text(page: str) -> str:
    """The main text of a page, a line per block."""
    return "\n".join(keep_blocks(blocks_of(page)))


def extract_main_text(pages: DataFrame, source: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``; a null or empty page has an empty text.

    Repeated rows each give a row; an empty table gives none; other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(source).alias("html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page or "") for page in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    bounded_batches(spark)
    return extract_main_text(load(spark, sf_dir, "pages"))
