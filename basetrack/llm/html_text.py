"""Main text of pages by consensus host paths.

Every page is read once as a flat run of tags and text.  Its containers
(article, main, section, div, td, ...) are scored by the text they hold less
the text in links, weighed by what their tag and class say.  The best
container's path of generalised tags and classes (digits and hashes in class
names apart) from the root is the page's vote.  Votes are counted per host in
Spark, combined before the shuffle, and the path with most votes wins (ties:
the larger summed score, then the larger path).  Pages are then joined with
their host's path and extracted again from the container at that path; a page
that has none is extracted from its own best one.  A path is a chain of 64-bit
hashes, so an open element costs the same however deep it stands.

Within the container menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are left out by tag, role, class or
id, also where the class names the article as well (``post-footer``,
``main-menu``): of a name's words the last one says what it is, and some say it
anywhere in it.  Words that articles use too (``related``, ``share``) say it
only of elements that hold others, and only if nothing but words for lists and
boxes stands beside them: ``related-posts`` goes, ``related-work`` stays.  Of these the ones that
a section of an article may have for its whole name (``discussion``) go only
if over half of their text is links or if they hold a form or comments.  A <header>, that of the article itself included, is a header
and left out; a heading outside of one stays.  Character references are
decoded, white space inside a block becomes one space, and blocks are joined by
a line feed.

A host may hold a third of all pages: votes are combined first.  The paths of
hosts are two longs a row; up to a checked number of them is broadcast, so
pages aren't shuffled, and beyond it pages are dealt by host, those of hot hosts
by page as well.

Rows: a null html gives an empty text; a null url, or one without a host, has
no host, so its page is read by itself; repeated rows each give a row; a page
without any container is read whole, and one without text gives an empty
string.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_SENT, checkpointed, hot_left_join

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
HEAD = frozenset("head script style noscript template iframe object svg math canvas audio video select button form input textarea label fieldset dialog nav header footer aside menu title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article main section div td body center blockquote dd li figure table".split())
CLOSES_P = BLOCK - {"html", "body"}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words of class names and ids of what isn't the article, anywhere in a name.
OUT = frozenset(
    """ad ads advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsored sponsors promo promos promotion promotions promotional
    navbar breadcrumb breadcrumbs pagination pager masthead topbar bottombar copyright colophon
    sidebar sidebars widget widgets cookie cookies consent gdpr popup modal overlay paywall toast newsletter subscribe subscription signup login
    comment comments commentlist respond disqus searchbox""".split()
)
# Words that say so if all other words of the name are of LISTS.
OFTEN_OUT = frozenset("related recommended recommendations trending popular discussion discussions share sharing social socials banner banners teaser teasers".split())
# Those of them that may be all of the name of an article's section.
MAY_BE_OWN = frozenset("related recommended recommendations trending popular discussion discussions".split())
# Words of names that say what kind of box or list an element is.
LISTS = frozenset(
    """article articles post posts story stories entry entries news item items list lists link links button buttons bar box block icon icons media page pages product products topic topics
    read reads section container wrapper wrap area group row column panel module more most this on us tool tools content site top main hero image images""".split()
)
# Elements that hold others.
HOLDERS = frozenset("div section ul ol dl table article main center figure td".split())
# Words that say the same unless the last word of the name is one of the article's.
OUT_LAST = frozenset("nav navigation navi menu menus toc header footer foot aside rail notice notices alert alerts disclaimer reply replies follow tags meta byline form search hidden".split())
# Words of class names and ids of what is the article.
IN = frozenset("article main content post entry story body text page".split())
# Words of names that say what is beside an element, not what it is.
BESIDE = frozenset("with has no without show".split())
# What makes even an <article> no part of the article.
NOT_OWN = frozenset("comment comments teaser teasers".split())
# a tag whose quotes don't close ends at its first >
tag = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)
attribute = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
word = re.compile(r"[A-Za-z]+")
humps = re.compile(r"(?<=[a-z])(?=[A-Z])")
space = re.compile(r"\s+")
unseen = re.compile(r"display\s*:\s*none", re.I).search
unseen_word = re.compile(r"(?:^|\s)hidden(?:\s|$)").search
numbers = re.compile(r"[0-9a-f]*\d[0-9a-f]*")
START, END, TEXT = 0, 1, 2


def events(page: str) -> Iterator[tuple]:
    """(START, name, attributes as text) and (END, name) and (TEXT, raw text); comments and raw elements' contents are gone."""
    at, n = 0, len(page)
    while at < n:
        m = tag.search(page, at)
        if m is None:
            yield TEXT, page[at:]
            return
        if m.start() > at:
            yield TEXT, page[at : m.start()]
        at = m.end()
        if m.group(2) is None:
            continue
        name = m.group(2).lower()
        if m.group(1):
            yield END, name
            continue
        yield START, name, m.group(3)
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(page, at)
            at = close.end() if close else n
            yield END, name


def names_of(attributes: str) -> tuple[list[list[str]], str, bool]:
    """The words of each name in class, id and role; the class for the path; whether it is hidden."""
    if not attributes.strip():
        return [], "", False
    found: dict[str, str] = {}
    for m in attribute.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    own = [[w.lower() for part in humps.split(name) for w in word.findall(part)] for k in ("class", "id") for name in found.get(k, "").split()]
    if found.get("role", "").lower() in ROLES:
        own.append(["nav"])
    hidden = found.get("aria-hidden", "").lower() == "true" or bool(unseen(found.get("style", "")) or unseen_word(attributes))
    general = ".".join(sorted({numbers.sub("*", c.lower()) for c in found.get("class", "").split()}))
    return [n for n in own if n], general, hidden


def often_out(names: list[list[str]]) -> tuple[bool, bool]:
    """Whether a name says by words that articles use too that an element is none of theirs, and whether that is certain."""
    said, certain = False, False
    for n in names:
        own = [w for w in n if w not in LISTS]
        if own and OFTEN_OUT.issuperset(own):
            said = True
            certain = certain or len(own) < len(n) or not MAY_BE_OWN.issuperset(own)
    return said, certain


def is_out(name: str, names: list[list[str]], hidden: bool) -> bool:
    """Whether an element can't be part of the article."""
    if name in HEAD or hidden:
        return True
    names = [n for n in names if not BESIDE.intersection(n)]
    if name in ("article", "main", "body", "html"):
        return name == "article" and (any(NOT_OWN.intersection(n) for n in names) or often_out(names)[0])
    if any(OUT.intersection(n) for n in names) or name in HOLDERS and often_out(names)[1]:
        return True
    own = name in ("div", "section") and any(IN.intersection(n) and not OUT_LAST.intersection(n) for n in names)
    return any(OUT_LAST.intersection(n) and (n[-1] in OUT_LAST if IN.intersection(n) else not own) for n in names)


def may_be_out(name: str, names: list[list[str]]) -> bool:
    """Whether what an element holds decides."""
    return name in HOLDERS and name != "article" and often_out([n for n in names if not BESIDE.intersection(n)])[0]


# What shows that readers write or choose there.
READERS_TAGS = frozenset("form textarea input button select".split())
READERS_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())


# the path of a whole page
WHOLE = 0


class Node:
    __slots__ = ("name", "path", "out", "weight", "text", "links", "start", "readers")

    def __init__(self, name, path, out, weight):
        self.name, self.path, self.out, self.weight = name, path, out, weight
        self.text = self.links = 0
        self.start: int | None = None  # of what is taken from it, if what it holds decides whether it is out
        self.readers = False


def containers(page: str | None, wanted: int | None = None) -> tuple[list[Node], list[str]]:
    """All containers of a page with their text and link counts, and the text blocks of those at ``wanted``."""
    root = Node("", WHOLE, False, 0)
    stack, found, taken = [root], [], []
    open_names: Counter[str] = Counter()  # so that nobody looks through the stack for what isn't there
    line: list[str] = []
    depth_link = 0
    inside = int(wanted == WHOLE)  # open containers at the wanted path

    def flush() -> None:
        if line:
            text = space.sub(" ", html_lib.unescape("".join(line))).strip()
            line.clear()
            if text:
                taken.append(text)

    def close(k: int) -> None:
        """Close the elements from k up."""
        nonlocal depth_link, inside
        while len(stack) > k:
            node = stack.pop()
            open_names[node.name] -= 1
            if node.name in BLOCK:
                flush()
            up = stack[-1]
            if node.name == "a":
                depth_link -= 1
            if not node.out and node.path == wanted and node.name in CONTAINER:
                inside -= 1
            if node.start is not None and (node.readers or 2 * node.links > node.text):
                del taken[node.start :]
                node.out = True
            up.readers = up.readers or node.readers
            if not node.out:
                up.text += node.text
                up.links += node.links

    for e in events(page or ""):
        if e[0] == TEXT:
            node = stack[-1]
            if not node.out:
                n = len(e[1].strip())
                node.text += n
                if depth_link:
                    node.links += n
                if inside:
                    line.append(e[1])
        elif e[0] == START:
            name = e[1]
            if name == "br":
                line.append(" ")
                continue
            if name in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1) if open_names["p"] else ():
                    if stack[k].name == "p":
                        close(k)
                        break
                    if stack[k].name in CONTAINER:
                        break
                if name == "li" or name in ("dd", "dt", "tr", "td", "th"):
                    same = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}[name]
                    for k in range(len(stack) - 1, 0, -1) if any(open_names[x] for x in same) else ():
                        if stack[k].name in same:
                            close(k)
                            break
                        if stack[k].name in ("ul", "ol", "dl", "table") or name in ("td", "th") and stack[k].name == "tr":
                            break
            if name in BLOCK:
                flush()
            if name in VOID:
                continue
            names, general, hidden = names_of(e[2])
            up = stack[-1]
            out = up.out or is_out(name, names, hidden)
            weight = 0
            if name in CONTAINER:
                weight = 3 * (name in ("article", "main")) + any(IN.intersection(n) for n in names)
            node = Node(name, xxhash.xxh64_intdigest(f"{name}.{general}".encode("utf-8", "replace"), up.path) >> 1, out, weight)
            if not out and may_be_out(name, names):
                flush()
                node.start = len(taken)
            node.readers = name in READERS_TAGS or any(READERS_WORDS.intersection(n) for n in names)
            stack.append(node)
            open_names[name] += 1
            if name == "a":
                depth_link += 1
            if name in CONTAINER and not out:
                found.append(node)
                if node.path == wanted:
                    inside += 1
        else:
            for k in range(len(stack) - 1, 0, -1) if open_names[e[1]] else ():
                if stack[k].name == e[1]:
                    close(k)
                    break
                if e[1] not in BLOCK and stack[k].name in BLOCK:
                    break
            else:
                if e[1] == "p":
                    flush()
    close(1)
    flush()
    return found, taken


def best(page: str | None) -> tuple[int, float]:
    """Path and score of the container that most likely is the article."""
    found, _ = containers(page)
    out = (WHOLE, 0.0)
    for node in found:
        score = (node.text - 2.0 * node.links) * (1.0 + 0.5 * node.weight)
        if node.name == "body":
            score *= 0.01
        # an outer container must hold clearly more than the inner one
        if score > 0 and (score > out[1] * 1.2 or out[1] == 0 or node.text - 2.0 * node.links > 0 and score > out[1]):
            out = (node.path, score)
    return out


def text_at(page: str | None, path: int | None) -> str:
    """Text of the containers at a path; of the page's own best one if there is none."""
    if path:
        found, taken = containers(page, path)
        if any(n.path == path for n in found):
            return "\n".join(taken)
    return "\n".join(containers(page, best(page)[0])[1])


def host(url: Column) -> Column:
    """The host of a URL; null if it has none."""
    found = F.lower(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    return F.when(found != "", found)


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes, score): how many pages of each host vote for each path, host as a hash; no path: those without a container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [best(p.as_py()) for p in batch.column(1)]
            paths = pa.array([path if score > 0 else None for path, score in got], pa.int64())
            yield pa.record_batch([batch.column(0), paths, pa.array([score for _, score in got], pa.float64())], names=["host", "path", "score"])

    rows = pages.select(F.xxhash64(host(F.col("url"))).alias("host"), F.col("html").cast("string")).where(host(F.col("url")).isNotNull())
    rows = rows.mapInArrow(run, "host long, path long, score double")
    return rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum(F.round("score").cast("long")).alias("score"))


def winners(pages: DataFrame) -> DataFrame:
    """(host, path, pages): one row for each host."""
    choice = F.when(F.col("path").isNotNull(), F.struct("votes", "score", "path"))
    return votes(pages).groupBy("host").agg(F.max(choice).path.alias("path"), F.sum("votes").alias("pages"))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages``."""
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), F.when(host(F.col("url")).isNotNull(), F.xxhash64(host(F.col("url")))).alias("host"))
    known = checkpointed(winners(pages))
    n, total = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("pages"), F.lit(0))).first()
    if n <= MOST_SENT:
        rows = rows.join(F.broadcast(known.select("host", "path")), "host", "left")
    else:
        rows = hot_left_join(rows, known, "host", "pages", total, "page_id", "url")
    rows = rows.select("page_id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_at(h.as_py(), p.as_py()) for h, p in zip(batch.column(2), batch.column(3))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    fields = rows.select("page_id", "url", F.lit("").alias("text")).schema
    return rows.mapInArrow(run, fields)


def query(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    return extracted(pages).withColumn("n_chars", F.char_length("text").cast("long"))
