"""Main text of web pages with a site style tree.

Pages of one host are merged: elements with the same path of tags and classes are one style node.
A leaf's importance is the entropy of what its pages show there, relative to the most it could be:
what every page repeats scores 0, what differs from page to page scores 1. A node's own importance
is the entropy of its presentations, the tags and classes that stand in it. Its composite
importance weighs its own with that of the contents below it. Branches of low importance are
removed from every page, those that mark an article included. Pages of one host with the same
article (or, without one, the same blocks) are one page, and what a page repeats on a path counts
once.

Entropy alone can't tell a menu whose entries differ on every page from an article. So elements
also count as noise by what they are (tag, role) or call themselves (whole class or id), and a page
that marks its article shows only what is in it; there a branch goes only if nearly all pages
repeat it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import column_type, materialise, possibly, slices, small_batches, text_or_empty
from .url_rules import host_of

#: A branch seen on at least so many different pages is removed below this importance; the second
#: threshold is for branches inside a marked article.
MIN_PAGES, LOW, LOW_IN_ARTICLE = 5, 0.3, 0.1
#: Weight of the contents below a node in its composite importance; the rest is its presentation's.
BELOW = 0.9

#: Deeper elements share the style of the one at this depth, as browsers bound the depth of a page;
#: longer labels of a path are hashed. So a block's path is bounded, however broken its page.
MAX_DEPTH, MAX_LABEL = 128, 24

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)(?:\s*>)?")
_ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(\"?)|'([^']*)('?)|([^\s>\"'][^\s>]*))?)?)")
_COMMENT_END = re.compile(r"--!?>")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup; elements that are dropped with what is in them, if they have an end tag.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in "script style textarea title iframe noembed noframes xmp".split()}
_DROPPED = frozenset("svg noscript template".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_NOISE_TAG = frozenset("nav header footer aside form menu dialog button select head".split())
_NOISE_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_NOISE_NAME = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu header masthead footer sidebar "
    "aside breadcrumb breadcrumbs cookie cookies consent notice notices popup modal overlay newsletter subscribe share sharing social comment comments "
    "replies disqus related recommended widget login signup search pagination pager toolbar "
    "ad-slot ad-banner ad-container ad-wrapper ad-box adsbygoogle site-header site-footer site-nav site-navigation main-nav main-navigation main-menu nav-bar nav-menu "
    "page-header page-footer cookie-banner cookie-notice cookie-consent social-links social-share share-buttons share-links sharing-buttons related-posts "
    "related-articles comment-list comments-area comment-form newsletter-signup search-form login-form widget-area promo-box breadcrumb-nav".split())
#: Elements that a name never makes noise.
_NEVER_NAMED = frozenset("html body main article".split())
_CLOSES = {"li": "li", "dt": "dd", "dd": "dt", "option": "option", "tr": "tr", "td": "td", "th": "th"}
_LISTS = frozenset("ul ol dl table menu".split())
NOISE, BODY, ARTICLE = 0, 1, 2


def _hides(attr: dict[str, str]) -> bool:
    return attr.get("role", "").lower() in _NOISE_ROLE or "hidden" in attr or attr.get("aria-hidden") == "true"


def _marks(attr: dict[str, str]) -> bool:
    return "main" in attr.get("role", "").lower().split() or "articlebody" in attr.get("itemprop", "").lower().split()


def _named(attr: dict[str, str]) -> bool:
    """Whether a whole class or the id is a name of noise; parts of layout names don't count."""
    return any(name.replace("_", "-") in _NOISE_NAME for name in (attr.get("class", "") + " " + attr.get("id", "")).lower().split())


def tokens(page: str) -> list[tuple]:
    """A page's texts (False, text), start tags (tag, attributes, whether self-closing) and end tags (tag,), in one pass.

    Comments end as in HTML: ``<!-->`` and ``<!--->`` at once, others at ``-->`` or ``--!>``. A
    quoted value may hold ``>``; where a quote or tag never ends, it and all tags after it end at
    the next ``>``, and what has none is text. So each character is looked at twice at most.
    """
    out: list[tuple] = []
    pos, size, last, quotes, svg = 0, len(page), page.rfind(">"), True, 0
    while pos < size:
        at = page.find("<", pos)
        if at < 0 or at >= last and not page.startswith(("<!--", "<![CDATA["), at):
            out.append((False, page[pos:]))
            break
        if at > pos:
            out.append((False, page[pos:at]))
        if page.startswith("<!--", at):
            if page.startswith(">", at + 4):
                pos = at + 5
            elif page.startswith("->", at + 4):
                pos = at + 6
            else:
                done = _COMMENT_END.search(page, at + 4)
                pos = done.end() if done else size
            continue
        if page.startswith("<![CDATA[", at):
            done = page.find("]]>", at + 9)
            out.append((False, page[at + 9:done if done >= 0 else size]))
            pos = done + 3 if done >= 0 else size
            continue
        m = _NAME.match(page, at)
        if not m:
            if page.startswith(("<!", "<?", "</"), at):  # a declaration, or not a tag
                pos = page.find(">", at) + 1
            else:
                out.append((False, "<"))
                pos = at + 1
            continue
        tag, pos, attr, closed = m[2].lower(), m.end(), {}, False
        if page[pos - 1] != ">":
            start = pos
            while quotes:
                step = _ATTRIBUTE.match(page, pos)
                if not step or step[3] is not None and not step[4] or step[5] is not None and not step[6]:
                    quotes = False  # it goes on to the end of the page
                    break
                pos = step.end()
                if step[1]:
                    closed = page[pos - 2] == "/"
                    break
                attr.setdefault(step[2].lower(), step[3] or step[5] or step[7] or "")
            if not quotes:
                pos = page.find(">", start) + 1
                closed, attr, step = page[pos - 2] == "/", {}, start
                while (found := _ATTRIBUTE.match(page, step, pos - 1)) and found.end() > step:
                    step = found.end()
                    attr.setdefault((found[2] or "").lower(), found[3] or found[5] or found[7] or "")
        if m[1]:
            svg -= tag == "svg" and svg > 0
            out.append((tag,))
            continue
        svg += tag == "svg" and not closed
        if tag in _RAW and not (closed and svg):
            done = _RAW[tag].search(page, pos)
            pos = page.find(">", done.end()) + 1 or size if done else size
            continue
        out.append((tag, attr, closed))
    return out


def _dropped(found: list[tuple]) -> dict[int, int]:
    """Start tags of dropped elements that have an end tag of their own, with its number; a block ends an svg, which then has none."""
    open_, out, foreign = {t: [] for t in _DROPPED}, {}, 0
    for k, token in enumerate(found):
        tag = token[0]
        if not tag:
            continue
        if len(token) == 1:
            if tag in _DROPPED and open_[tag]:
                out[open_[tag].pop()] = k
            foreign -= tag == "foreignobject" and foreign > 0
        elif tag in _DROPPED:
            if not token[2]:
                open_[tag].append(k)
        elif tag == "foreignobject":
            foreign += 1
        elif tag in _BLOCK and not foreign:
            open_["svg"].clear()
    return out


def blocks(page: str) -> tuple[bool, list[tuple[str, int, str]], dict[str, list[str]]]:
    """Whether the page marks an article; its blocks in order: style path, kind, text; and by path what stands in its elements.

    An element that is noise only by name isn't if it holds an article or main, but for an article
    inside another one (a comment, say), and for teasers beside the page's article. The work is in
    proportion to the page, however deep or broken it is.
    """
    out: list[tuple[str, int, int, str]] = []
    # tag, path, depth, kind, the innermost element around that is noise only by name, places of what a sibling closes
    stack: list[tuple[str, str, int, int, int, dict[str, int]]] = [("", "", 0, BODY, 0, {})]
    opened: dict[str, int] = {}  # open elements by tag
    held: list[str] = []
    marked = False
    shown: dict[str, list[str]] = {}
    around = [0]  # of an element with a name of noise, the next one around it
    cleared: set[int] = {0}  # elements with a name of noise that hold an article; with each, those around it
    maybe: set[int] = {0}  # the same, if the page has no other article

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((stack[-1][1], stack[-1][3], stack[-1][4], text))

    def cut(k: int) -> None:
        for x in stack[k:]:
            opened[x[0]] -= 1
        del stack[k:]

    def close(tag: str) -> None:
        if not opened.get(tag):
            return
        k = len(stack) - 1
        block = stack[k][0] in _BLOCK
        while stack[k][0] != tag:
            k -= 1
            block = block or stack[k][0] in _BLOCK
        # inline tags of the same kind as what is around them don't end a block
        if block or stack[-1][3:5] != stack[k - 1][3:5]:
            flush()
        cut(k)

    found = tokens(page)
    dropped, at = _dropped(found), 0
    while at < len(found):
        k, token = at, found[at]
        tag, at = token[0], at + 1
        if not tag:
            held.append(token[1])
            continue
        if len(token) == 1:
            if tag in _BLOCK:
                flush()
            close(tag)
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in _DROPPED:
            at = dropped.get(k, k) + 1
            continue
        if tag in _BLOCK:
            flush()
            close("p")
            if tag in _CLOSES and (open_at := max(stack[-1][5].get(tag, 0), stack[-1][5].get(_CLOSES[tag], 0))):
                cut(open_at)  # an open sibling ends here, unless a list or table lies between
        if tag in _VOID:
            continue
        _, path, depth, kind, name, near = stack[-1]
        attr = token[1]
        main = tag in ("article", "main") or bool(attr) and _marks(attr)
        # an article's own header holds its title
        if tag in _NOISE_TAG and not (tag == "header" and kind == ARTICLE) or attr and _hides(attr):
            kind = NOISE
        elif main and kind != NOISE:
            if tag == "main" or not opened.get("article"):
                into, outer = cleared if kind == ARTICLE else maybe, name
                while outer not in into:
                    into.add(outer)
                    outer = around[outer]
            kind, marked = ARTICLE, True
        elif attr and kind != NOISE and tag not in _NEVER_NAMED and _named(attr):
            around.append(name)
            name = len(around) - 1
        if tag in _BLOCK:
            if depth < MAX_DEPTH:
                label = tag + ("." + ".".join(sorted(attr["class"].replace("/", "").split())) if attr.get("class") else "")
                if len(label) > MAX_LABEL:
                    label = f"{label[:8].split('.')[0]}.{_hash(label) + (1 << 63):x}"
                if path:
                    shown.setdefault(path, []).append(label)
                path, depth = f"{path}/{label}", depth + 1
                shown.setdefault(path, [])
        elif (kind, name) != stack[-1][3:5]:
            flush()
        if tag in _LISTS:
            near = {}
        elif tag in _CLOSES:
            near = {**near, tag: len(stack)}
        stack.append((tag, path, depth, kind, name, near))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    if not any(kind == ARTICLE and name in cleared for _, kind, name, _ in out):
        cleared |= maybe
    return marked, [(path, kind if name in cleared else NOISE, text) for path, kind, name, text in out], shown


_BLOCKS = "marked boolean, page bigint, blocks array<struct<path:string,kind:int,content:bigint,text:string>>, nodes array<struct<path:string,shown:bigint>>"
_ARROW = pa.list_(pa.struct([("path", pa.string()), ("kind", pa.int32()), ("content", pa.int64()), ("text", pa.string())]))
_NODES = pa.list_(pa.struct([("path", pa.string()), ("shown", pa.int64())]))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html", 1 << 20, 256):
            marks, digests, found, nodes = [], [], [], []
            for page in part.column("html").to_pylist():
                marked, rows, shown = blocks(page)
                own = ARTICLE if marked else BODY
                marks.append(marked)
                digests.append(_hash(repr([(p, t) for p, k, t in rows if k == own])))
                # kept: what the page may show; of the rest only that and where it was
                found.append([{"path": p, "kind": k, "content": _hash(t), "text": t if k == own else None} for p, k, t in rows])
                nodes.append([{"path": p, "shown": _hash(" ".join(x))} for p, x in shown.items()])
            keep = part.drop_columns(["html"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(marks), pa.array(digests, pa.int64()), pa.array(found, _ARROW), pa.array(nodes, _NODES)], [*keep.schema.names, "marked", "page", "blocks", "nodes"])


def prefixes(path: Column) -> Column:
    """A node's path and those of all nodes around it."""
    steps = F.split(path, "/")  # the first is empty
    return F.transform(F.sequence(F.lit(2), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))


def _entropy(total: Column, nln: Column) -> Column:
    """Relative to the most it could be; what is seen once is all important."""
    return F.when(total > 1, (F.ln(total) - nln / total) / F.ln(total)).otherwise(1.0)


def style_tree(pages: DataFrame) -> DataFrame:
    """``pages`` (host, page, blocks, nodes) -> (host, path, pages, presentation, content, importance) for every style node.

    ``content`` is the mean importance of the contents in the branch, ``importance`` its composite.
    Each different page of a host (by ``page``, a digest) counts once, and so does a content that
    it repeats on a path. Copies are dropped and counts are summed by host, path and content first,
    so a host with most of the pages is spread over all tasks until only one row per distinct
    content is left.
    """
    seen = F.array_distinct(F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), b["content"].alias("what"))))
    once = pages.select("host", "page", seen.alias("seen"), "nodes").groupBy("host", "page").agg(F.first(F.struct("seen", "nodes")).alias("x"))
    once = materialise(once.select("host", "x.seen", "x.nodes"), "distinct-pages")

    def entropies(rows: DataFrame, name: str) -> DataFrame:
        counts = rows.groupBy("host", "path", "what").agg(F.count(F.lit(1)).cast("double").alias("n"))
        sums = counts.groupBy("host", "path").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.ln("n")).alias("nln"))
        return sums.select("host", "path", "all", _entropy(F.col("all"), F.col("nln")).alias(name))

    shown = once.select("host", F.explode(F.transform("nodes", lambda x: F.struct(x["path"].alias("path"), x["shown"].alias("what")))).alias("x")).select("host", "x.*")
    content = entropies(once.select("host", F.explode("seen").alias("x")).select("host", "x.*"), "content").where("path <> ''")
    below = content.select("host", F.explode(prefixes(F.col("path"))).alias("path"), "all", "content")
    below = below.groupBy("host", "path").agg((F.sum(F.col("all") * F.col("content")) / F.sum("all")).alias("content"))
    both = entropies(shown, "presentation").withColumnRenamed("all", "pages").join(below, ["host", "path"])
    return both.withColumn("importance", F.lit(BELOW) * F.col("content") + F.lit(1 - BELOW) * F.col("presentation"))


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, low: float = LOW,
              low_in_article: float = LOW_IN_ARTICLE) -> DataFrame:
    """The main text of every page.

    Returns one row per input row: the id and URL columns, ``text`` (blocks in page order, joined
    by an empty line; empty if none), ``n_chars`` (its code points). Null HTML is empty. Ids may
    repeat or be null; an empty table gives an empty result; other columns play no part.
    """
    small_batches(df.sparkSession)
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host_of(F.col(url_col)).alias("host"), text_or_empty(html_col).alias("html"))
    parsed = pages.mapInArrow(_parse, f"id {column_type(df, id_col)}, url string, host string, {_BLOCKS}")
    parsed = materialise(parsed.withColumn("uid", F.monotonically_increasing_id()), "blocks")
    weak = style_tree(parsed).where((F.col("pages") >= min_pages) & (F.col("importance") < low)).select("host", "path", "importance")
    weak = materialise(weak, "weak-branches")
    own = F.when(F.col("marked"), ARTICLE).otherwise(BODY)
    # each page meets the weak branches of its host by the paths of its own blocks, however many the host has
    paths = F.array_distinct(F.transform(F.filter("blocks", lambda b: b["kind"] == F.col("own")), lambda b: b["path"]))
    at = parsed.withColumn("own", own).select("uid", "host", "marked", F.explode(paths).alias("block")).where("block <> ''")
    hit = at.withColumn("path", F.explode(prefixes(F.col("block")))).join(weak, ["host", "path"])
    hit = hit.where(~F.col("marked") | (F.col("importance") < low_in_article)).groupBy("uid").agg(F.collect_set("block").alias("weak"))
    hit = materialise(hit, "weak-blocks")
    text = lambda keep: F.array_join(F.transform(F.filter("blocks", keep), lambda b: b["text"]), "\n\n")
    mine = lambda b: b["kind"] == F.col("own")
    maybe, sure = possibly(parsed.withColumn("own", own).select("uid", "id", "url", "own", "blocks"), hit, ["uid"])
    sure = sure.select("id", "url", text(mine).alias("text"))
    cut = maybe.join(hit, "uid", "left").withColumn("weak", F.coalesce("weak", F.array().cast("array<string>")))
    cut = cut.select("id", "url", text(lambda b: mine(b) & ~F.array_contains("weak", b["path"])).alias("text"))
    both = sure.unionByName(cut)
    return both.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
