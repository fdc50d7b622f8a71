"""Main text of web pages with site style trees.

Pages are read into element trees.  The trees of one host are merged by path (the names
and attributes of the elements from the root, positions left out).  For each path the
merged tree knows how its presentation (the elements inside) and its content (the text
inside) vary over the host's pages; the entropy of each, on a scale of 0 to 1, says how
much of it is the page's own.  A branch in which neither varies is decoration of the site
and is taken out of each page, as are elements whose name or class says that they are
navigation, advert, form or the like.  A form round most of the page's paragraphs, or round
its article, is a frame of the page and stays.  What remains inside ``article`` or ``main``
is the text if it is at least half of all that remains; otherwise all of that is.

The counts are combined per (host, path, value) and then per (host, path), so that a host
with a third of all pages is counted like any other.  A branch is judged if it stands on
``LEAST_BRANCH`` pages, however many its host has.  A host's branches of decoration are
never one list: they meet the paths of each page in a salted join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import by_value, looked_up, staged

by_value(__name__)

#: Pages a host must have for its branches to be judged, and pages a branch must stand on.
LEAST_PAGES = 8
LEAST_BRANCH = 4
#: Branches whose presentation and content both vary less than this are decoration.
LEAST_IMPORTANCE = 0.3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>\"'<]*)((?:[^>\"'<]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>\"'<]*)([^><]*)>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.I)
_RAW = {n: re.compile(rf"</{n}\b[^>]*>?", re.I) for n in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var".split()
)
#: Elements that hold no main text, by name, role, and word of class or id.
_NAMES = set("head nav footer aside script style noscript template iframe svg math button select textarea dialog object canvas menu title xmp".split())
_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_WORDS = set(
    "ad ads adv advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
    "login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion promoted "
    "recommended related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar "
    "widget overlay".split()
)
#: Parts of a page that may carry one of those words and still be the text's own frame.
_FRAMES = set("html body main article".split())
_TEXTS = set("post entry story main content".split())
_CLOSED_BY = {
    "p": set("p div article section header footer main aside nav ul ol dl table form h1 h2 h3 h4 h5 h6 pre blockquote hr figure address details fieldset".split()),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"},
}
_CONTROLS = set("input select textarea button label".split())
_LONG = (1 << 63) - 1


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) & _LONG


class Page:
    """A page's elements and runs of text, read leniently in one pass.

    ``nodes`` are ``[parent, path, dropped, framed, plain]``: the place of the parent, the
    hash of the path, whether the element is dropped by name or class, whether it stands
    in ``article`` or ``main``, and whether the path below those has no attributes.  Texts
    of dropped elements count in no branch.
    Inline elements are no nodes; they neither part words nor hold text of their own.
    """

    def __init__(self, html: str | None):
        html = html or ""
        self.nodes: list[list] = [[-1, 0, False, False, False]]
        self.texts: list[tuple[int, str]] = []  # node, text; an empty text parts blocks
        self.spans: list[list[int]] = [[0, 0, 0, 0]]  # number of texts and presentation sum, at begin and end
        self.forms: set[int] = set()
        self.paragraphs: set[int] = set()
        self.fields: set[int] = set()  # what holds a control or a label directly
        style = at = 0
        stack = [("", 0)]
        hashes: dict[str, int] = {}

        def text(until: int) -> None:
            if until > at:
                found = html[at:until]
                if "&" in found:
                    found = unescape(found)
                self.texts.append((stack[-1][1], found))

        def close(depth: int) -> None:
            while len(stack) > depth:
                _, node = stack.pop()
                self.spans[node][2:] = len(self.texts), style
            self.texts.append((stack[-1][1], ""))

        position = 0
        while match := _TOKEN.search(html, position):
            text(match.start())
            position = at = match.end()
            slash, name, rest = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
            if not name:
                continue  # a comment or a declaration
            name = name.lower()
            if slash:
                if name in _INLINE:
                    continue
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == name:
                        close(depth)
                        break
                else:
                    self.texts.append((stack[-1][1], ""))
                continue
            if name in _CONTROLS:
                self.fields.add(stack[-1][1])
            if name in _RAW:
                end = _RAW[name].search(html, position)
                position = at = end.end() if end else len(html)
                continue
            if name in _VOID:
                self.texts.append((stack[-1][1], ""))
                continue
            attributes = dict((m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)) if rest.strip(" /") else {}
            if name in _INLINE and not attributes:
                continue
            if name in _INLINE:
                name = "span"
            while len(stack) > 1 and name in _CLOSED_BY.get(stack[-1][0], ()):
                close(len(stack) - 1)
            if name != "span":
                self.texts.append((stack[-1][1], ""))
            parent = self.nodes[stack[-1][1]]
            label = f"{name} {attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}"
            if label not in hashes:
                hashes[label] = _hash(label)
            framed = parent[3] or name in ("article", "main")
            node = [
                stack[-1][1],
                _mixed(parent[1], hashes[label]),
                parent[2] or _decoration(name, attributes, parent[3]),
                framed,
                framed and (not parent[3] or parent[4]) and (name in _FRAMES or not attributes),
            ]
            if name == "form":
                self.forms.add(len(self.nodes))
            elif name == "p":
                self.paragraphs.add(len(self.nodes))
            style += hashes[label]
            stack.append((name, len(self.nodes)))
            self.nodes.append(node)
            self.spans.append([len(self.texts), style, 0, 0])
            if rest.endswith("/") and name not in _FRAMES and name in ("svg", "math"):
                close(len(stack) - 1)
        text(len(html))
        close(1)
        if self.forms:
            self._drop_forms()

    def _drop_forms(self) -> None:
        """Drop the forms that frame neither an article nor most of the page's paragraphs."""
        read = [0] * len(self.nodes)  # characters of paragraphs in each element
        for node, text in self.texts:
            if not self.nodes[node][2]:
                read[node] += len("".join(text.split()))
        total = sum(read)
        holds = [n if i in self.paragraphs and i not in self.fields else 0 for i, n in enumerate(read)]
        for i in range(len(self.nodes) - 1, 0, -1):  # children come after their parents
            if not self.nodes[i][2]:
                holds[self.nodes[i][0]] += holds[i]
        framed = {self.nodes[i][0] for i in range(1, len(self.nodes)) if self.nodes[i][3] and not self.nodes[i][2]}
        for i in range(len(self.nodes) - 1, 0, -1):
            if i in framed:
                framed.add(self.nodes[i][0])
        for i, node in enumerate(self.nodes[1:], 1):
            kept = i not in self.forms or (i in framed and not self.nodes[node[0]][3]) or 2 * holds[i] > total
            node[2] = node[2] or not kept or self.nodes[node[0]][2]

    def branches(self) -> dict[int, tuple[int, int]]:
        """Presentation and content of each judged path, as hashes."""
        found: dict[int, tuple[int, int]] = {}
        content = [0]  # sums of the texts' hashes
        for node, text in self.texts:
            words = "" if self.nodes[node][2] else text.strip()
            content.append(content[-1] + _hash(words) if words else content[-1])
        for (_, path, dropped, _, plain), (t0, s0, t1, s1) in zip(self.nodes[1:], self.spans[1:], strict=True):
            if not dropped and not plain:
                style, own = found.get(path, (0, 0))
                found[path] = (style + s1 - s0) & _LONG, (own + content[t1] - content[t0]) & _LONG
        return found

    def text(self, decoration: set[int]) -> str:
        """The text without the branches whose path is in ``decoration``."""
        removed = [True] * len(self.nodes)
        for i, (parent, path, dropped, _, plain) in enumerate(self.nodes):
            removed[i] = dropped or (parent >= 0 and removed[parent]) or (not plain and path in decoration)
        framed = total = 0
        for node, text in self.texts:
            if text and not removed[node]:
                n = len("".join(text.split()))
                total += n
                framed += n if self.nodes[node][3] else 0
        frames_only = total > 0 and 2 * framed >= total
        wanted = [not gone and (node[3] or not frames_only) for gone, node in zip(removed, self.nodes, strict=True)]
        blocks, block = [], []
        for node, text in self.texts:
            if not text:
                blocks.append("".join(block))
                block = []
            elif wanted[node]:
                block.append(text)
        blocks.append("".join(block))
        return " ".join(" ".join(blocks).split())


def _mixed(parent: int, label: int) -> int:
    return ((parent * 0x9E3779B97F4A7C15 + 1) ^ label) * 0xBF58476D1CE4E5B9 & _LONG


def _decoration(name: str, attributes: dict[str, str], framed: bool) -> bool:
    if name in _NAMES or (name == "header" and not framed):
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if attributes.get("role", "").lower() in _ROLES:
        return True
    words = set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", attributes.get("class", "") + " " + attributes.get("id", "")).lower()))
    if not framed and "header" in words and not words & {"article", "post", "entry", "content"}:
        return True
    if name == "article" and words & _TEXTS:
        return False  # such as "post has-comments"
    return bool(words & _WORDS)


HOST = "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def _host(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1))


def decorations(pages: DataFrame, url_col: str = "url", html_col: str = "html", least: float = LEAST_IMPORTANCE) -> DataFrame:
    """The merged trees' branches of low importance: ``host, path``."""
    chosen = pages.select(_host(url_col).alias("host"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append((host, 0, -1, 0))  # the page itself
                for path, values in Page(html).branches().items():
                    rows += [(host, path, kind, value) for kind, value in enumerate(values)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["host", "path", "kind", "value"])

    seen = chosen.mapInArrow(run, "host string, path long, kind int, value long")
    values = seen.groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("double")
    # Entropy over n pages of a branch: log n - sum(c log c) / n, as a share of log n.
    paths = values.groupBy("host", "path", "kind").agg(F.sum("n").alias("pages"), F.sum(n * F.log(n)).alias("same"))
    varies = F.when(F.col("pages") > 1, 1 - F.col("same") / (F.col("pages") * F.log("pages"))).otherwise(1.0)
    branches = paths.groupBy("host", "path").agg(F.max("pages").alias("pages"), F.max("kind").alias("kind"), F.max(varies).alias("importance"))
    hosts = branches.filter("kind = -1").select("host", F.col("pages").alias("host_pages"))
    low = branches.filter((F.col("kind") >= 0) & (F.col("importance") < least))
    judged = hosts.filter(F.col("host_pages") >= LEAST_PAGES)
    return low.filter(F.col("pages") >= LEAST_BRANCH).join(judged, "host", "left_semi").select("host", "path")


def _page_key(id_col: str, url_col: str, html_col: str) -> Column:
    """Tells pages apart; wholly equal ones share it."""
    return F.struct(F.col(id_col).cast("string").alias("id"), F.xxhash64(url_col, html_col).alias("hash"))


def removed_paths(pages: DataFrame, low: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page, paths`` of the pages that have branches of ``low``: the page's key, and those
    of its own paths."""
    chosen = pages.select(_page_key(id_col, url_col, html_col).alias("page"), _host(url_col).alias("host"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(Page(html).branches()) for html in batch.column(2).to_pylist()]
            owner = pa.array([i for i, own in enumerate(found) for _ in own], pa.int64())
            paths = pa.array([path for own in found for path in own], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), paths], names=["page", "host", "path"])

    schema = T.StructType([chosen.schema["page"], chosen.schema["host"], T.StructField("path", T.LongType())])
    own = chosen.mapInArrow(run, schema).select("page", F.struct("host", "path").alias("branch"))
    met = looked_up(own, low.select(F.struct("host", "path").alias("branch")), "branch", "page")
    return met.groupBy("page").agg(F.collect_set(F.col("branch")["path"]).alias("paths"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Null and empty pages, and pages of decoration alone, have an empty text.  Pages without
    a host share the host "".  Repeated rows each give a row; empty tables give an empty
    result.
    """
    low = staged(decorations(pages, url_col, html_col), "decorations")
    found = staged(removed_paths(pages, low, id_col, url_col, html_col), "removed-paths")
    chosen = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _page_key(id_col, url_col, html_col).alias("page")
    ).join(found, "page", "left").select("page_id", "url", "html", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, paths = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            texts = [Page(h).text(set(p or ())) if h else "" for h, p in zip(html, paths, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    schema = T.StructType([chosen.schema["page_id"], chosen.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return chosen.mapInArrow(run, schema)
