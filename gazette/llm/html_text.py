"""Main text of pages by a site style tree.

Pages of a host are merged into one tree: an element's place is the path of its styles (tag, class and id of it and of
all elements around it). Over the pages that have an element, the entropy of its child styles says how much its
presentation varies, and the entropy of its texts over pages says whether its content is the page's own. A branch whose
combined importance is low is the same from page to page and is removed from each page. HTML's own names are the prior:
what is marked up as menu, advert, form, comments and the like has importance 0, and so has what stands outside of the
article of a page that has one; an article itself has 1. The tree decides about all else, within articles too.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm.common import slices, stored

#: Elements that never hold main text.
DROPPED = set("head title script style noscript template textarea select option button svg math iframe object embed canvas audio video map form fieldset nav aside footer dialog menu".split())
#: Classes, ids and roles that mark boilerplate; each is one whole token, so ``no-sidebar`` and ``content-sidebar-wrap`` mark nothing.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar "
    "aside complementary footer contentinfo masthead cookie cookies consent gdpr newsletter subscribe subscription signup login search searchbox form "
    "share sharing social related recommended recommendations popup modal overlay widget widgets pagination pager skip hidden".split()
)
#: Those that are boilerplate within an article too. The others only make a branch of an article less important: a table of
#: class ``form`` or a section on related work may be the story's own.
FIRM = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer "
    "cookie cookies consent gdpr newsletter subscribe subscription signup share sharing pagination pager popup modal overlay".split()
)
COMMENTS = set("comment comments commentlist respond disqus replies".split())
#: Elements within articles whose names are their own: ``<h2 id="comments">``.
TITLES = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: How an element is marked: by its tag or as hidden, by a name (or as a form or a page's header), by a name of comments.
SURE, WORD, COMMENT = 1, 2, 3
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre section summary table tbody tfoot thead tr caption ul".split()
)
MAIN = {"article", "main"}
#: Style paths grow to about this length; what is nested deeper counts as part of that place.
LONGEST = 2000
#: Elements that end at the next one of these, if none of their parents stands between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|noscript|template|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[/!?][^>]*>|([^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("tag", "path", "parent", "mark", "main", "begins", "noise", "kept", "size", "own", "holds", "children")

    def __init__(self, tag: str, path: str, parent: Element | None, mark: int, main: bool, begins: bool):
        self.tag, self.path, self.parent, self.mark, self.main, self.begins = tag, path, parent, mark, main, begins
        self.noise, self.kept, self.size, self.own, self.holds, self.children = False, False, 0, 0, False, []


def settle(elements: list[Element], pieces: list[tuple[str, Element]]) -> None:
    """Which elements are noise: those with a sure mark, those with a word for a mark that aren't a wrapper, and all below.

    A wrapper holds most of the text of a page without any article or main element outside of marked ones (comments are
    none), or holds such an element with at least as much text as everything unmarked, if all that have text are within
    marked elements.
    """
    for e in elements:  # parents come first
        e.noise = e.parent.noise or e.mark == SURE
    if any(e.mark in (WORD, COMMENT) and not e.noise for e in elements):
        for text, e in pieces:
            e.own += len("".join(text.split()))
        for e in reversed(elements):
            if not e.noise:
                e.size += e.own
                e.parent.size += e.size
                e.parent.holds |= e.holds or (e.begins and e.size > 0)
        total = sum(e.own for e in {e for _, e in pieces} if not e.noise)

        def outside() -> list[Element]:
            covered: set[Element] = set()
            for e in elements:
                if e.noise or e.parent in covered or (e.mark in (WORD, COMMENT) and not e.kept):
                    covered.add(e)
            return [e for e in elements if e not in covered]

        if not any(e.begins for e in outside()):
            for e in elements:
                e.kept = e.mark == WORD and e.size > e.own and 2 * e.size > total
        clean = outside()
        if not any(e.begins and e.size for e in clean):
            unmarked = sum(e.own for e in clean)
            for e in elements:
                e.kept |= e.holds and e.size >= unmarked
    for e in elements:
        e.noise = e.parent.noise or e.mark == SURE or (e.mark in (WORD, COMMENT) and not e.kept)


def parse(page: str) -> tuple[list[tuple[str, str, bool]], list[Element]]:
    """Blocks of text outside of boilerplate as (path, text, within main), and all elements, in page order.

    Never fails: unclosed and misplaced tags end where the elements around them end.
    """
    root = Element("", "", None, 0, False, False)
    stack, elements, held, pieces, runs = [root], [], [], [], []

    def flush() -> None:
        if held:
            runs.append((next(e for e in reversed(stack) if e.tag in BLOCKS or e is root), held.copy()))
            pieces.extend(held)
            held.clear()

    for raw, close, name, attributes, text in _TOKEN.findall(page):
        if text:
            held.append((text, stack[-1]))
            continue
        if not name:
            continue
        tag = name.lower()
        if close:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth and (tag in BLOCKS or not any(e.tag in BLOCKS for e in stack[depth + 1 :])):
                if tag in BLOCKS:
                    flush()
                del stack[depth:]
            elif tag == "p":
                flush()
            continue
        if tag in ("br", "td", "th", "img", "hr"):
            held.append((" ", stack[-1]))
        if tag in BLOCKS:
            flush()
            depth = len(stack) - 1
            while depth and stack[depth].tag not in BLOCKS:
                depth -= 1
            if stack[depth].tag == "p":
                del stack[depth:]
        if tag in ENDS:
            same, around = ENDS[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in around or stack[depth].tag in MAIN:
                    break
                if stack[depth].tag in same:
                    del stack[depth:]
                    break
        if tag in VOID:
            stack[-1].children.append(tag)
            continue
        given = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes.strip(" /\n\t") else {}
        named = f"{given.get('class', '')} {given.get('id', '')} {given.get('role', '')}".lower()
        words, names = _WORD.findall(named), set(named.split())
        parent = stack[-1]
        begins = tag in MAIN or "main" in given.get("role", "").split() or given.get("itemprop") == "articleBody"
        inside = parent.main or begins
        mark, weak = 0, False
        if (tag in DROPPED and tag != "form") or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower():
            mark = SURE
        elif tag not in ("html", "body") and tag not in MAIN and not (inside and tag in TITLES) and names & COMMENTS:
            mark = COMMENT
        elif tag == "form" or (tag == "header" and not inside) or (tag not in ("html", "body") and tag not in MAIN and not (inside and tag in TITLES) and names & MARKS):
            weak = parent.main and tag not in ("form", "header") and not names & FIRM
            mark = 0 if weak else WORD
        if mark and tag not in BLOCKS:
            held.append((" ", parent))
        style = ".".join([tag, *sorted(set(words))])
        path = f"{parent.path}>{'*' * begins}{'~' * weak}{style}" if len(parent.path) < LONGEST else parent.path
        made = Element(tag, path, parent, mark, inside, begins)
        parent.children.append(style)
        elements.append(made)
        if not attributes.rstrip().endswith("/"):
            stack.append(made)
    flush()
    settle(elements, pieces)
    blocks = []
    for top, several in runs:
        text = " ".join(html.unescape("".join(text for text, e in several if not e.noise)).split())
        if text:
            blocks.append((top.path, text, top.main and not top.noise))
    if any(main for _, _, main in blocks):
        blocks = [b for b in blocks if b[2]]
    return blocks, elements


def _number(text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) << 31 ^ zlib.adler32(data) ^ len(data) << 20


def host_of(url):
    """Host of an address in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


def parts(pages: DataFrame) -> DataFrame:
    """What the trees are made of, (host, path, kind, feature), per page and style path once each: the element's child
    styles (kind ``look``, repeats in a row count once) and the texts of its blocks (kind ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("feature", pa.int64())])
        for whole in batches:
            for batch in slices(whole, "html"):
                rows = []
                for host, page in zip(*(c.to_pylist() for c in batch.columns)):
                    blocks, elements = parse(page or "")
                    seen = {(path, "text", _number(text)) for path, text, _ in blocks}
                    looks: dict[str, list[str]] = {}
                    for e in elements:
                        looks.setdefault(e.path, []).append(",".join(c for i, c in enumerate(e.children) if not i or e.children[i - 1] != c))
                    seen |= {(path, "look", _number(";".join(dict.fromkeys(several)))) for path, several in looks.items()}
                    rows += [(host, *one) for one in seen]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, kind string, feature long")


def style_tree(parts: DataFrame, weight: float = 0.9) -> DataFrame:
    """(host, path, pages, importance) of the merged tree of each host, from the parts of its pages.

    With m pages that have the element, presentation importance is the entropy of its child styles to the base m.
    Content importance is 1 less the mean, over the different texts in the branch, of the entropy of a text over the
    pages that show it, which is log_m of their number. The importance is ``weight`` times content plus the rest times
    presentation; an element seen on one page only has 1. All is counted by grouping, combined before the shuffle.
    """
    counted = parts.groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("n"))
    look = F.col("kind") == "look"
    own = counted.groupBy("host", "path").agg(
        F.sum(F.when(look, F.col("n")).otherwise(0)).alias("pages"),
        F.sum(F.when(look, F.col("n") * F.log("n")).otherwise(0.0)).alias("looks"),
        F.sum(F.when(look, 0).otherwise(1)).alias("texts"),
        F.sum(F.when(look, 0.0).otherwise(F.log("n"))).alias("shared"),
    )
    steps = F.split("path", ">")
    above = F.explode(F.transform(F.sequence(F.lit(2), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), ">")))
    branch = own.where("path like '>%'").select("host", above.alias("branch"), "texts", "shared").groupBy("host", "branch").agg(F.sum("texts").alias("all_texts"), F.sum("shared").alias("all_shared"))
    m = F.col("pages")
    presentation = F.when(m > 1, (F.log(m) - F.col("looks") / m) / F.log(m)).otherwise(1.0)
    content = F.when((m > 1) & (F.col("all_texts") > 0), 1 - F.col("all_shared") / F.col("all_texts") / F.log(m)).otherwise(1.0)
    return own.join(branch.withColumnRenamed("branch", "path"), ["host", "path"]).select("host", "path", "pages", F.when(m > 1, weight * content + (1 - weight) * presentation).otherwise(1.0).alias("importance"))


def lasting(blocks: list[tuple[str, str, bool]], low: set[str]) -> list[str]:
    """Texts of the blocks that stand in no low branch.

    Of a block in an article (a starred step) only branches below the innermost one count, and only as long as they hold
    no more than half of that article's text: what several pages tell alike is their story then, and the article stays
    whole. One too deep to be a step of its own can't be told from what is around it, and stays.
    """
    if not low:
        return [text for _, text, _ in blocks]
    goes: dict[str, bool] = {}
    articles: dict[str, list[str]] = {}
    whole: dict[str, int] = {}
    gone: dict[str, int] = {}
    for path, text, main in blocks:
        if path not in goes:
            steps = path.split(">")
            stars = [i for i, step in enumerate(steps) if step.startswith("*")]
            articles[path] = [">".join(steps[: i + 1]) for i in stars]
            goes[path] = (bool(stars) or not main) and any(">".join(steps[: i + 1]) in low for i in range(stars[-1] + 1 if stars else 1, len(steps)))
        for article in articles[path]:
            whole[article] = whole.get(article, 0) + len(text)
            gone[article] = gone.get(article, 0) + len(text) * goes[path]

    def story(path: str) -> bool:
        return bool(articles[path]) and 2 * gone[articles[path][-1]] > whole[articles[path][-1]]

    return [text for path, text, _ in blocks if not goes[path] or story(path)]


def low_branches(tree: DataFrame, hosts: DataFrame, least_pages: int, threshold: float, doubt: float = 0.2) -> DataFrame:
    """(host, low): the paths of each host that are to go.

    Within an article a branch goes only if at least half of the host's pages have it, so a passage that some pages share
    stays; a doubtful name there (a step that begins with ``~``) raises the threshold by ``doubt``.
    """
    within, doubtful = F.col("path").rlike(">[*]"), F.col("path").rlike(">[*]?~[^>]*$")
    limit = F.lit(threshold) + F.when(doubtful, doubt).otherwise(0.0)
    common = ~within | (2 * F.col("pages") >= F.col("host_pages"))
    unimportant = tree.where((F.col("pages") >= least_pages) & (F.col("importance") < threshold + doubt)).join(hosts, "host")
    return unimportant.where(common & (F.col("importance") < limit)).groupBy("host").agg(F.collect_list("path").alias("low"))


def main_text(pages: DataFrame, least_pages: int = 5, threshold: float = 0.3) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars (code points of the text).

    Blocks are joined by one line feed; character references are decoded, white space within a block becomes one space.
    Boilerplate by name goes; if a page has an article or main element with text, so does all outside of it. Of the rest
    the branches go whose importance in the host's tree is under ``threshold`` (elements on fewer than ``least_pages``
    pages are kept); an article itself is no such branch, branches within one must be on half of the host's pages at least,
    and one that would lose more than half of its text stays whole. Null, empty and textless pages have an empty text; rows that repeat stay; null addresses share a tree; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = ["\n".join(lasting(parse(page or "")[0], set(low or ()))) for page, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    tree = style_tree(stored(parts(pages), "page-parts"))
    hosts = pages.groupBy(host_of(F.col("url")).alias("host")).agg(F.count("*").alias("host_pages"))
    low = stored(low_branches(tree, hosts, least_pages, threshold), "low-branches")  # a table of known size is broadcast while small, so that pages stay where they are
    met = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host")).join(low, "host", "left").select("page_id", "url", "html", "low")
    schema = T.StructType([*met.schema.fields[:2], T.StructField("text", T.StringType())])
    return met.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
