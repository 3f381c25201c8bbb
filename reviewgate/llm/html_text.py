"""Main text of pages by consensus host paths (operator 10).

Every page scores its containers: text outside links counts fully for the element that
holds it directly and less for each element further out, and elements that name
themselves an article count more. From the best container the page climbs to the outermost
element that names itself an article around it, or else to the outermost one inside the body
whose other text is not mostly links: titles, leads and sections beside the longest one belong
to the text. That element's path of tags and classes, digits generalised, is the page's vote.
Votes are summed per host in Spark; each page is then extracted again at its host's winning
path, without blocks of links that lie outside the best containers. Where that is less than
``LEAST_SHARE`` of what the page's own path holds, the blocks of both are taken.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are left out, by tag, class, id, role or label. A name that says nothing else (like
``sidebar`` or ``comment-list``) is enough. One that says more, or stands beside the name of an
article (``news-alert``, ``post promo``), is not: such an element goes unless it holds most of
the page's text outside links and at least ``ARTICLE_CHARS`` of it. Names that only file a post
(``category-...``, ``tag-...``) say nothing. A page of boilerplate alone gives an empty text.
Character references are decoded, white space inside a
block becomes one space, blocks are joined in page order by a line feed. A line break
inside a block is white space.

Cases: a null or empty page, and one without text, gives an empty text; unclosed and
wrongly nested tags close where browsers close them, a tag cut off by the page's end is
dropped; pages without a host vote together; equal votes go to the path first in
alphabetical order; pages are read whole; repeated rows are rows of their own; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewgate.llm.url_filter import with_parts
from reviewgate.session import materialise

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|</?[a-zA-Z][^>]*\Z",
    re.S,
)
NAMED = re.compile(
    r"(?:^|[\s\"'/])(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I | re.S
)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

RAW = {"script", "style", "textarea", "title", "iframe", "noframes", "xmp"}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
    "source", "track", "wbr",
}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn",
    "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rt", "rp", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "br", "img",
}
#: Blocks that hold text but never name a container.
LEAVES = {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "blockquote", "td", "th",
    "figcaption", "caption", "address", "summary",
}
#: What an opening tag closes, and the elements beyond which it does not look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
DROPPED_TAGS = {
    "head", "nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template",
    "iframe", "svg", "button", "select", "textarea", "input", "menu", "dialog", "object",
    "noframes", "xmp", "title", "canvas", "audio", "video",
}
DROPPED_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor",
    "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "newsletter", "subscribe", "subscription", "signup", "sidebar", "aside", "menu", "nav", "navbar",
    "navigation", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "share", "sharing",
    "social", "related", "recommended", "comment", "comments", "respond", "reply", "replies",
    "disqus", "popup", "modal", "overlay", "login", "search", "pagination", "pager", "toolbar",
    "widget", "complementary", "contentinfo", "alert", "alertdialog", "form", "discussion",
    "discussions", "responses", "reviews", "feedback",
}
#: Names of reader comments, which may be articles of their own by tag.
COMMENT_NAMES = {
    "comment", "comments", "reply", "replies", "respond", "responses", "discussion", "discussions",
}
#: Words that may stand beside such a name without saying anything else.
NEUTRAL_WORDS = {
    "area", "bar", "block", "body", "box", "container", "content", "customer", "global", "inner",
    "item", "left", "links", "list", "main", "outer", "page", "policy", "primary", "reader",
    "right", "secondary", "section", "site", "thread", "top", "bottom", "user", "wrap", "wrapper",
}
#: Names that boilerplate has, but other things as well.
UNSURE_NAMES = {"form", "alert", "header", "promo", "reviews", "feedback", "search"}
#: First words of names that file a post under a topic.
FILING_WORDS = {"category", "cat", "tag", "tagged", "topic", "format", "type"}
#: Text outside links that an element with an unsure name must hold to be an article.
ARTICLE_CHARS = 200
#: Words before a name that make it a property of a layout.
LAYOUT_WORDS = {"has", "with", "no", "without", "is"}
NEVER_BY_NAME = {"html", "body", "main"}
BONUS = {"article": 1.5, "main": 1.3}
CONTENT_NAMES = {"article", "content", "entry", "post", "story", "main", "text", "body"}
OUTER = 0.8
#: Elements around the whole page, to which no article climbs.
WHOLE_PAGE = {"", "html", "body"}
#: Share of the text at a page's own path below which its host's path holds a teaser.
LEAST_SHARE = 1 / 3


def _attributes(raw: str) -> dict[str, str]:
    if "=" not in raw:
        return {}
    found: dict[str, str] = {}
    for name, *values in NAMED.findall(raw):
        found.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return found


def _parts(value: str) -> list[str]:
    return [x.lower() for x in NAME_PARTS.findall(value)]


HIDDEN = re.compile(r"(?:^|[\s/])hidden(?=[\s/=]|\Z)", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")


def _hidden(raw: str) -> bool:
    return "hidden" in raw.lower() and HIDDEN.search(QUOTED.sub("\"\"", raw)) is not None


SURE, UNSURE = "sure", "unsure"


def _boilerplate(tag: str, given: dict[str, str]) -> str | None:
    """Whether an element's names make it boilerplate, surely or unless it holds the article."""
    if tag in NEVER_BY_NAME or not given:
        return None
    found, article = None, tag == "article"
    for kind, value in given.items():
        for name in value.split() if kind != "aria-label" else [value]:
            words = _parts(name)
            if not words:
                continue
            known = DROPPED_NAMES.intersection(words)
            if not known:
                article = article or words[0] in CONTENT_NAMES and kind == "class"
            elif words[0] in FILING_WORDS or LAYOUT_WORDS.intersection(words):
                continue
            elif COMMENT_NAMES.intersection(words) and all(
                x in DROPPED_NAMES or x in NEUTRAL_WORDS for x in words
            ):
                return SURE
            else:
                whole = all(x in DROPPED_NAMES or x in NEUTRAL_WORDS for x in words)
                sure = whole and not (len(words) == 1 and words[0] in UNSURE_NAMES)
                found = SURE if sure or found == SURE else UNSURE
    return UNSURE if found and article else found


def _label(tag: str, given: dict[str, str]) -> str:
    names = sorted(re.sub(r"\d+", "#", x) for x in given.get("class", "").split())
    return ".".join([tag, *names])


def read_blocks(page: str) -> list[tuple[str, str, int]]:
    """Container path, text and characters in links of each block, in page order."""
    out: list[tuple[str, str, int]] = []
    #: Open elements: tag, and whether they are dropped.
    stack: list[tuple[str, bool]] = []
    paths = [""]
    #: Elements with an unsure name: those open at each depth, and those around each block.
    unsure: list[tuple[int, ...]] = [()]
    around: list[tuple[int, ...]] = []
    n_unsure = 0
    buffer: list[str] = []
    linked = [0]
    dropped = links = 0

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                out.append((paths[-1], text, linked[0]))
                around.append(unsure[-1])
            buffer.clear()
        linked[0] = 0

    def close(to: int) -> None:
        nonlocal dropped, links
        while len(stack) > to:
            tag, gone = stack.pop()
            paths.pop()
            unsure.pop()
            dropped -= gone
            links -= tag == "a"

    def add(text: str) -> None:
        if text and not dropped:
            text = html.unescape(text) if "&" in text else text
            buffer.append(text)
            if links:
                linked[0] += len(text)

    at = 0
    while (found := MARKUP.search(page, at)) is not None:
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        ending, tag, raw = found[1], found[2], found[3]
        if tag is None:
            ending, tag, raw = found[4], found[5], found[6]
        if tag is None:
            continue
        tag = tag.lower()
        if ending:
            if tag not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in INLINE or all(x in INLINE for x, _ in stack[i:]):
                        close(i)
                    break
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
            # A block closes an open paragraph with what is open inside it.
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
            if tag in CLOSES:
                ends, beyond = CLOSES[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        close(i)
                        break
                    if stack[i][0] in beyond:
                        break
        given = _attributes(raw)
        named = _boilerplate(tag, given)
        gone = tag in DROPPED_TAGS or named == SURE or _hidden(raw)
        stack.append((tag, gone))
        if named == UNSURE:
            unsure.append((*unsure[-1], n_unsure))
            n_unsure += 1
        else:
            unsure.append(unsure[-1])
        dropped += gone
        links += tag == "a"
        if tag in INLINE or tag in LEAVES:
            paths.append(paths[-1])
        else:
            paths.append(f"{paths[-1]}>{_label(tag, given)}")
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            if end is None:
                add(page[at:])
                at = len(page)
                break
            add(page[at : end.start()])
            at = end.start()
    add(page[at:])
    flush()
    return _without_unsure(out, around) if n_unsure else out


def _without_unsure(
    blocks: list[tuple[str, str, int]], around: list[tuple[int, ...]]
) -> list[tuple[str, str, int]]:
    """Blocks outside elements with an unsure name that don't hold most of the page's text."""
    held: Counter = Counter()
    total = 0
    for (_, text, linked), names in zip(blocks, around):
        n = max(0, len(text) - linked)
        total += n
        for name in names:
            held[name] += n
    article = {x for x, n in held.items() if n >= ARTICLE_CHARS and 2 * n > total}
    return [b for b, names in zip(blocks, around) if all(x in article for x in names)]


def blocks_of(page: str | None) -> list[tuple[str, str, int]]:
    """Blocks of a page without its boilerplate."""
    return read_blocks(page) if page else []


def best_path(blocks: list[tuple[str, str, int]]) -> str | None:
    """Path of the container with the highest score."""
    direct: Counter = Counter()
    for path, text, linked in blocks:
        direct[path] += max(0, len(text) - 2 * linked)
    scores: dict[str, float] = {}
    for path, n in direct.items():
        share, outer = 1.0, path
        while True:
            scores[outer] = scores.get(outer, 0.0) + share * n
            if not outer:
                break
            outer = outer.rpartition(">")[0]
            share *= OUTER
    for path in scores:
        last = path.rpartition(">")[2]
        tag, _, names = last.partition(".")
        scores[path] *= BONUS.get(tag, 1.0)
        if tag not in BONUS and CONTENT_NAMES.intersection(_parts(names)):
            scores[path] *= 1.2
    if not scores:
        return None
    return min(scores, key=lambda x: (-scores[x], x))


def _inside(path: str, outer: str) -> bool:
    return path == outer or path.startswith(outer + ">")


def _of_article(path: str, core: str) -> bool:
    """Whether a container is an article by its tag, or by name and around the best one."""
    tag, _, names = path.rpartition(">")[2].partition(".")
    return tag in BONUS or path != core and bool(CONTENT_NAMES.intersection(_parts(names)))


def whole_path(blocks: list[tuple[str, str, int]], core: str) -> str:
    """Path of the outermost container around the best one that is article text as well."""
    steps = core.split(">")
    if steps[-1].partition(".")[0] in WHOLE_PAGE:
        return core
    around = [
        ">".join(steps[: k + 1])
        for k, step in enumerate(steps)
        if step.partition(".")[0] not in WHOLE_PAGE
    ]
    named = next((x for x in around if _of_article(x, core)), None)
    if named is not None:
        return named
    for outer in around:
        rest = [x for x in blocks if _inside(x[0], outer) and not _inside(x[0], core)]
        if 2 * sum(x[2] for x in rest) <= sum(len(x[1]) for x in rest):
            return outer
    return core


def _blocks_at(blocks: list[tuple[str, str, int]], path: str, cores: set[str]) -> set[int]:
    """Numbers of the blocks at a path; those of links only inside a best container."""
    return {
        i
        for i, (p, text, linked) in enumerate(blocks)
        if _inside(p, path) and (2 * linked <= len(text) or any(_inside(p, c) for c in cores))
    }


def text_at(blocks: list[tuple[str, str, int]], path: str | None, core: str | None) -> str:
    """Blocks at the host's path, one per line, and at the page's own if those are few."""
    if not blocks:
        return ""
    own = best_path(blocks)
    taken = _blocks_at(blocks, path, {core, own}) if path is not None else set()
    mine = _blocks_at(blocks, whole_path(blocks, own), {own})
    size = sum(len(blocks[i][1]) for i in taken)
    if size < LEAST_SHARE * sum(len(blocks[i][1]) for i in mine):
        taken |= mine
    return "\n".join(blocks[i][1] for i in sorted(taken))


def host_paths(pages: DataFrame, page: str = "html", url: str = "url") -> DataFrame:
    """``host``, ``path`` with most votes of the host's pages, and its usual ``core``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: Counter = Counter()
            for host, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                blocks = blocks_of(value)
                core = best_path(blocks)
                if core is not None:
                    votes[host, whole_path(blocks, core), core] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array([x[i] for x in votes], pa.string()) for i in range(3)],
                    pa.array(list(votes.values()), pa.int64()),
                ],
                ["host", "path", "core", "n"],
            )

    hosted = with_parts(pages.select(F.col(url).alias("url"), F.col(page).alias("page")))
    votes = hosted.select("host", "page").mapInArrow(
        run, "host string, path string, core string, n long"
    )
    winners = (
        votes.groupBy("host", "path", "core")
        .agg(F.sum("n").alias("n"))
        .groupBy("host", "path")
        .agg(
            F.min_by("core", F.struct(-F.col("n"), F.col("core"))).alias("core"),
            F.sum("n").alias("n"),
        )
        .groupBy("host")
        .agg(
            F.min_by(F.struct("path", "core"), F.struct(-F.col("n"), F.col("path"))).alias("best")
        )
        .select("host", "best.path", "best.core")
    )
    # Written: its size is looked at before it is joined, and pages are scored once.
    return materialise(winners, "host-paths")


#: Largest list of host paths that is broadcast.
MAX_BROADCAST_HOSTS = 50_000


def extract(
    pages: DataFrame, winners: DataFrame, key: str = "page_id", url: str = "url",
    page: str = "html",
) -> DataFrame:
    """Key, url and ``text`` of every page, taken at its host's path."""
    schema = T.StructType(
        [
            T.StructField(key, pages.schema[key].dataType),
            T.StructField(url, T.StringType()),
            T.StructField("text", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (2, 3, 4)]
            texts = [text_at(blocks_of(x), path, core) for x, path, core in zip(*columns)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema.names
            )

    hosted = with_parts(
        pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(page).alias("page"))
    ).select("id", "url", "page", "host")
    small = winners.count() <= MAX_BROADCAST_HOSTS
    joined = hosted.join(F.broadcast(winners) if small else winners, "host", "left")
    return joined.select("id", "url", "page", "path", "core").mapInArrow(run, schema)
