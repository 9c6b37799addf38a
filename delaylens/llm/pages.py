"""Main text of web pages by consensus on host paths.

Each page's containers are scored by the text they hold; the best one stands
for the article round it, and the page votes for that one's generalised path
(tags and classes, digits made equal).
Votes are counted per host in Spark, and every page is extracted again from
the containers on its host's winning path; a page that has none, or no text in
them, uses its own best container.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import blocks, spread_join, with_fields, written

#: Share of a block's length that counts for the container one level further out.
FADE = 0.6

# Elements by what they do to the text around them.
DROPPED = frozenset("aside button canvas datalist dialog embed footer form head header iframe input map menu nav noscript object optgroup option script search select style svg template textarea title video audio".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article blockquote body center div html main section table tbody td tr".split())
KEPT = frozenset("html body main article".split())
# Words of class, id and role that mark what is no part of an article.
MARKS = frozenset(
    "ad ads adsense advert adverts advertisement advertising affiliate alert banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies dialog disclaimer disqus footer footnav gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup privacy promo promotion promotions recommended related reply replies respond rss search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola tags teaser toc toolbar tooltip topbar trending widget widgets".split()
)
# a quote opens a quoted value only after an equals sign
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>|<[!?][^>]*>""", re.S)
# a name stands where an attribute starts, never inside a value
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of a page's unlinked text that makes a form a container like others.
FORM_SHARE = 0.5
# Words of class and id that tell nothing by themselves.
GENERIC = frozenset("area articles bar block body bottom box button buttons card cards center col column container content copyright footer form group header icon icons inner item items layer left links list main message news outer panel posts right row section slot stories strip text title top unit wrap wrapper".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")


def _attributes(tag: str, raw: str, strict: bool, inside: bool) -> tuple[str, bool]:
    """The tag's part of a path, and whether its attributes say that it is no part of an article.

    Ids of headings, and those of sections ``inside`` an article, are made
    from titles and tell nothing of what stands there.
    """
    if "=" not in raw and "hidden" not in raw.lower():
        return tag, False
    part, marked, seen = tag, False, set()
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), a or b or c
        if name in seen:  # the first of a name counts
            continue
        seen.add(name)
        if name == "class":
            part += "".join("." + _DIGITS.sub("#", x) for x in sorted(value.split()))
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            marked = True
        elif strict and (name in ("class", "role") or name == "id" and not (tag in _HEADINGS or inside and tag == "section")) and any(map(_marks, unescape(value).split())):
            marked = True
    return part, marked and tag not in KEPT


def _marks(name: str) -> bool:
    """Whether a class or id names what is no part of an article: a word of ``MARKS`` comes last or leads words that tell nothing (``cookie-notice``, ``share-buttons``, not ``share-price``)."""
    own = [w.lower() for w in _WORD.findall(name)]
    while own and own[-1] in GENERIC and own[-1] not in MARKS:
        own.pop()
    return bool(own) and own[-1] in MARKS


def containers(html: str, strict: bool = True, forms: bool = False) -> list[tuple[str, int, int, float, list[tuple[int, str]], int]]:
    """A page's containers in page order: path, depth, number of the enclosing one (-1: none), score, own blocks (place, text), unlinked less linked length of these.

    With ``forms`` a form is a container; without, the first container says at
    its end how much unlinked text was dropped for being in a form.
    """
    found: list[list] = [["", 0, -1, 0.0, [], 0, 0]]
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # name, container, dropped (2: only as part of a form)
    text: list[str] = []
    linked, in_link, place, articles = 0, False, 0, 0

    def flush() -> None:
        nonlocal linked, place
        block = " ".join("".join(text).split()) if text else ""
        text.clear()
        if block:
            place += 1
            k, worth = stack[-1][1], max(0, len(block) - 2 * linked)
            found[k][4].append((place, block))
            found[k][5] += len(block) - 2 * linked
            while k >= 0 and worth >= 1:
                found[k][3] += worth
                k, worth = found[k][2], worth * FADE
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        if not stack[-1][2] and piece:
            piece = unescape(piece) if "&" in piece else piece
            text.append(piece)
            if in_link:
                linked += len(piece.strip())
        elif stack[-1][2] == 2 and not in_link:
            found[0][6] += len(piece.strip())

    at, skip_to = 0, 0
    for m in _TAG.finditer(html):
        if m.start() < skip_to:
            continue
        say(html[max(at, skip_to) : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                in_link = False
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    if name in BLOCKS:
                        flush()
                    articles -= sum(x[0] in ("article", "main") for x in stack[k:])
                    del stack[k:]
                    break
            else:
                if name in BLOCKS:
                    flush()
            continue
        if name in BLOCKS:
            flush()
            if stack[-1][0] == "p" or name in ("li", "dd", "dt", "tr", "td", "th") and stack[-1][0] == name or name in ("dd", "dt", "td", "th") and stack[-1][0] in ("dd", "dt", "td", "th"):
                stack.pop()
        if name == "br" or name in VOID:
            say(" ")
            continue
        if m[3].endswith("/") and name not in BLOCKS:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, m.end())
            skip_to = at = end.end() if end else len(html)
            continue
        if name == "a":
            in_link = True
        part, marked = _attributes(name, m[3], strict, articles > 0)
        drop = stack[-1][2]
        if drop != 1 and (marked or name in DROPPED and not (forms and name == "form")):
            drop = 2 if name == "form" and not marked else 1
        articles += name in ("article", "main")
        if (name in CONTAINERS or name == "form") and not drop:
            up = stack[-1][1]
            found.append([f"{found[up][0]}>{part}" if up else part, found[up][1] + 1, up, 0.0, [], 0, 0])
            stack.append((name, len(found) - 1, 0))
        elif name in BLOCKS or drop:
            stack.append((name, stack[-1][1], drop))
    say(html[max(at, skip_to) :])
    flush()
    return [tuple(x) for x in found]


def best_container(found: list) -> int:
    """The container of the highest score; the outermost of equals.  -1 if the page has no text."""
    k = max(range(len(found)), key=lambda k: (found[k][3], -k))
    return k if found[k][3] > 0 or any(x[4] for x in found) else -1


def _tags(path: str) -> list[str]:
    return [part.split(".")[0] for part in path.split(">")]


def article_round(found: list, k: int) -> int:
    """The outermost container round ``k`` that is of the same article; ``k`` itself if there is none.

    That is an enclosing article, a main where no article is nearer, or a
    container with unlinked text of its own (body only outside of those two);
    what it adds must not be mostly links.
    """
    worth = [x[5] for x in found]
    for i in range(len(found) - 1, 0, -1):  # inner ones come later
        worth[found[i][2]] += worth[i]
    up = found[k][2]
    while up > 0:
        tag, inner = _tags(found[up][0])[-1], _tags(found[k][0])
        named = tag == "article" or tag == "main" and "article" not in inner
        own = found[up][5] > 0 and (tag not in ("html", "body") or "article" not in inner and "main" not in inner)
        if (named or own) and worth[up] >= worth[k]:
            k = up
        up = found[up][2]
    return k


def article_container(found: list) -> int:
    """The container of the page's article; -1 if the page has no text."""
    k = best_container(found)
    return article_round(found, k) if k >= 0 else k


def text_of(found: list, path: str | None) -> str:
    """The blocks of the articles round the containers on ``path`` (of the page's own article if none is there or none has text)."""
    chosen = {article_round(found, k) for k, x in enumerate(found) if x[0] == path} if path is not None else set()
    if not chosen:
        k = article_container(found)
        chosen = {k} if k >= 0 else set()
    own: list[tuple[int, str]] = []
    inside: set[int] = set()
    for k, x in enumerate(found):
        if k in chosen or x[2] in inside:
            inside.add(k)
            own += x[4]
    if not own and path is not None:
        return text_of(found, None)
    return "\n".join(b for _, b in sorted(own))


def _worth(found: list) -> int:
    """Length of a page's unlinked text less that of its linked text."""
    return sum(max(0, x[5]) for x in found)


def parsed(html: str | None) -> list:
    """A page's containers; where the marks of classes leave no text, without heeding them.

    A form that holds most of the page's text (some servers put one round
    every page) is a container like others.
    """
    strict, forms = True, False
    while True:
        found = containers(html or "", strict, forms)
        if not forms and found[0][6] > FORM_SHARE * (found[0][6] + _worth(found)):
            forms = True
        elif strict and not any(x[4] for x in found):
            strict = False
        else:
            return found


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The winning path of each host: ``host``, ``path`` (null where no page has text), and its number of pages ``n``.

    A page votes once, for the path of its article's container.  Most votes win, then
    the higher score, then the path that sorts first.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "html"):
            rows = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = parsed(page)
                k = article_container(found)
                rows.append((host, found[k][0], int(found[k][3])) if k >= 0 else (host, None, 0))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["host", "path", "score"])

    votes = pages.select(host_of(F.col(url)).alias("host"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html")).mapInArrow(vote, "host string, path string, score long")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    best = F.min(F.when(F.col("path").isNotNull(), F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "path")))
    return counted.groupBy("host").agg(best.alias("w"), F.sum("votes").alias("n")).select("host", F.col("w.path").alias("path"), "n")


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """All columns but ``html``, and ``text``: the page's article, a line for each block.

    White space inside a block is one space, ``<br>`` included.  Null and
    empty pages, and pages without text, give an empty text; a page without a
    usable URL is counted with the others that have none.  A column ``text``
    of ``pages`` is replaced; no other name can clash.  Every row gives a row.
    """
    paths = written(host_paths(pages, url, html), "host-paths")
    kept = [c for c in pages.columns if c not in (html, "text")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("html"))
    total = paths.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = spread_join(rows.withColumn("_at", F.monotonically_increasing_id()), paths, ["host"], "n", total, salt="_at").select("row", "html", "path")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "html"):
            texts = [text_of(parsed(page), path) if page else "" for page, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    found = joined.mapInArrow(cut, with_fields(joined.select("row"), "text string"))
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "text")
