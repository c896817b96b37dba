"""Main text of web pages by wrapper induction.

Pages of one host are aligned with a reference page of that host (of median length) by simple
tree matching: the largest order-preserving match of two DOM trees whose matched nodes agree
in label and have matched parents. Over all pages of the host, a node of the reference whose
text is the same nearly everywhere is template, one whose text varies is a slot; what a page
has beyond the reference is content. Counts are summed inside tasks and by an aggregate, so
a host that holds a third of the pages is no group of its own anywhere.

What varies on every page and still is no article (adverts, menus, footers, comments) is known
by its element, role or class. The ``article`` and ``main`` elements, all of them in page order, are
the place to look; without one it is the whole body. If all text there is template (a host
of copies), the text stays.

Blocks are joined by one newline, white space inside a block is one space, character
references are decoded. Defined results: null or empty html gives empty text; markup that is
cut off or never closed is closed at the end; pages without a host form a host of their own;
repeated rows are extracted each; further columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passlane.llm.common import broadcast_if, cut, ship

# Elements of HTML, by how they are parsed and what they hold.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|iframe|textarea|title"
FOREIGN = frozenset(("svg", "math"))
# Dropped with what they hold if they are closed by a tag of their own.
UNSHOWN = frozenset("template select svg object canvas audio video annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr option optgroup".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"optgroup"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
ASIDE_TAGS = frozenset("head nav footer aside form button menu dialog label input fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies disqus discussion footer gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notices overlay paywall popup promo promoted promotion recommended related replies reply respond responses "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split())
# Words that name no aside by themselves but may stand beside one that does, as in "site-footer" or "ad-slot-1".
BESIDE_WORDS = frozenset(
    "area bar block bottom box btn button container content form global group inner item items left link links list "
    "main outer page primary right secondary section site slot top unit wrap wrapper".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond responses".split())
NEVER_ASIDE = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())  # by a word

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[a-z]+")


def aside_words(token: str, known: frozenset[str]) -> set[str]:
    """The words of a class or id that name an aside: all its words are known ones or such as stand beside them."""
    words = set(WORD.findall(token))
    return words & known if words <= known | BESIDE_WORDS else set()


class Page:
    """A DOM tree: nodes in document order, and the text runs with the node that holds each."""

    def __init__(self, source: str | None):
        self.tags, self.labels, self.parents, self.aside = ["html"], ["html"], [-1], [False]
        self.children: list[list[int]] = [[]]
        self.named: dict[int, set[str]] = {}  # asides by the words of a class or id alone
        self.ended = [False]  # by an end tag of its own
        self.runs: list[tuple[int, str | None]] = []  # None: a block ends or begins
        stack, at, source = [0], 0, source or ""
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self.runs.append((stack[-1], source[at:m.start()]))
            at = m.end()
            tag = m[3] or m[6]
            if not tag:
                continue
            tag, attributes = tag.lower(), m[4] or m[7] or ""
            if m[2] or m[5]:
                self._close(stack, tag)
            elif tag == "br":
                self.runs.append((stack[-1], " "))
            else:
                self._open(stack, tag, attributes)
        if at < len(source):
            self.runs.append((stack[-1], source[at:]))
        self._keep_bulk()
        unshown = [False] * len(self.tags)
        for k in range(1, len(self.tags)):
            unshown[k] = unshown[self.parents[k]] or (self.tags[k] in UNSHOWN and self.ended[k])
            self.aside[k] |= self.aside[self.parents[k]] or unshown[k]
        self.runs = [(k, run) for k, run in self.runs if run is not None or not unshown[k]]

    def _keep_bulk(self) -> None:
        """What is an aside by a word only, and no comments, stays one only without most of the text."""
        marked = list(self.named)
        if not marked:
            return
        size = [0] * len(self.tags)
        for node, run in self.runs:
            if run:
                size[node] += len(run.strip())
        for k in range(len(self.tags) - 1, 0, -1):
            if self.aside[k] and k not in self.named:
                size[k] = 0
            size[self.parents[k]] += size[k]
        for k in marked:
            if not self.named[k] & COMMENT_WORDS and 2 * size[k] > size[0]:
                self.aside[k] = False

    def _open(self, stack: list[int], tag: str, attributes: str) -> None:
        if tag in ("html", "body") and (tag == "html" or tag in self.tags):
            return
        if tag in CLOSES_P:
            self._pop_to(stack, {"p"}, {"article", "section", "div", "td", "li", "body", "blockquote"} | UNSHOWN)
        if tag in CLOSES:
            for _ in range(3):
                self._pop_to(stack, *CLOSES[tag])
        if tag in BLOCK:
            self.runs.append((stack[-1], None))
        if tag in VOID or (attributes.endswith("/") and (tag in FOREIGN or any(self.tags[k] in FOREIGN for k in stack))):
            return
        words, tokens = set(), []
        role, hidden = "", False
        if attributes:
            for name, value in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'").lower()
                if name in ("class", "id"):
                    words |= set(WORD.findall(value))
                    tokens += [(name, t) for t in value.split()]
                elif name == "role":
                    role = value.strip()
                elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                    hidden = True
        node, parent = len(self.tags), stack[-1]
        inside = any(self.tags[k] in ("article", "main") for k in stack)
        aside = hidden or tag in ASIDE_TAGS or (tag == "header" and not inside) or role in ASIDE_ROLES
        if not aside and tag not in NEVER_ASIDE and role != "main":
            known = ASIDE_WORDS - {"header"} if inside else ASIDE_WORDS
            named = set()
            for name, token in tokens:
                # ids of sections inside an article are made from their headings
                named |= aside_words(token, COMMENT_WORDS if name == "id" and tag == "section" and inside else known)
            if named:
                self.named[node] = named
                aside = True
        self.tags.append(tag)
        self.labels.append(" ".join([tag, *sorted(words)]))
        self.parents.append(parent)
        self.aside.append(aside)
        self.ended.append(False)
        self.children.append([])
        self.children[parent].append(node)
        stack.append(node)
        if role == "main":
            self.tags[node] = "main"

    def _pop_to(self, stack: list[int], tags: set[str], stop: set[str]) -> None:
        """Close the nearest open element of ``tags``, unless one of ``stop`` is nearer."""
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[k]]
            if tag in tags:
                self.runs.append((stack[-1], None))
                del stack[k:]
                return
            if tag in stop:
                return

    def _close(self, stack: list[int], tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tags[stack[k]] == tag or self.labels[stack[k]].split(" ", 1)[0] == tag:
                if tag in BLOCK:
                    self.runs.append((stack[-1], None))
                self.ended[stack[k]] = True
                del stack[k:]
                return
        if tag in BLOCK:
            self.runs.append((stack[-1], None))

    def own_texts(self) -> list[str]:
        """Text held directly by each node, white space folded."""
        parts: list[list[str]] = [[] for _ in self.tags]
        for node, run in self.runs:
            if run is not None:
                parts[node].append(run)
        return [" ".join(" ".join(p).split()) for p in parts]

    def roots(self) -> set[int]:
        """The outermost article and main elements with text outside asides; else the whole page."""
        found = set()
        for node, run in self.runs:
            if run and not self.aside[node] and run.strip():
                top, k = None, node
                while k >= 0:
                    if self.tags[k] in ("article", "main"):
                        top = k
                    k = self.parents[k]
                if top is not None:
                    found.add(top)
        return found or {0}

    def text(self, template: set[int]) -> str:
        roots = self.roots()
        inside = [False] * len(self.tags)
        for k in range(len(self.tags)):
            inside[k] = not self.aside[k] and (k in roots or (k > 0 and inside[self.parents[k]]))
        out = self._blocks([i and k not in template for k, i in enumerate(inside)]) if template else ""
        return out or self._blocks(inside)

    def _blocks(self, keep: list[bool]) -> str:
        blocks, now = [], []
        for node, run in [*self.runs, (0, None)]:
            if run is None:
                if now:
                    block = " ".join(htmllib.unescape("".join(now)).split())
                    if block:
                        blocks.append(block)
                    now = []
            elif keep[node]:
                now.append(run)
        return "\n".join(blocks)


def simple_tree_matching(a: Page, b: Page) -> dict[int, int]:
    """Nodes of ``b`` matched to nodes of ``a``: the largest top-down, order-preserving match."""
    memo: dict[tuple[int, int], list] = {}

    def alike(x: int, y: int) -> bool:
        return a.labels[x] == b.labels[y]

    def weigh(x: int, y: int) -> None:
        p, q = a.children[x], b.children[y]
        table = [[0] * (len(q) + 1)]
        for i, u in enumerate(p):
            row, above = [0], table[i]
            for j, v in enumerate(q):
                best = above[j + 1] if above[j + 1] >= row[j] else row[j]
                w = 0
                if alike(u, v):
                    below = memo.get((u, v))
                    w = 1 + below[-1][-1] if below else 1
                row.append(above[j] + w if w and above[j] + w > best else best)
            table.append(row)
        memo[x, y] = table

    # Pairs with children, each after the pairs below it.
    open_pairs = [(0, 0, False)] if alike(0, 0) and a.children[0] and b.children[0] else []
    while open_pairs:
        x, y, ready = open_pairs.pop()
        if ready:
            weigh(x, y)
            continue
        open_pairs.append((x, y, True))
        open_pairs += [(u, v, False) for u in a.children[x] if a.children[u]
                       for v in b.children[y] if b.children[v] and alike(u, v)]

    found, todo = {}, [(0, 0)] if alike(0, 0) else []
    while todo:
        x, y = todo.pop()
        found[y] = x
        table = memo.get((x, y))
        if table is None:
            continue
        p, q, i, j = a.children[x], b.children[y], len(a.children[x]), len(b.children[y])
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                todo.append((p[i - 1], q[j - 1]))
                i, j = i - 1, j - 1
    return found


class Reference:
    """A host's reference page, parsed once."""

    def __init__(self, source: str):
        self.page = Page(source)
        self.texts = self.page.own_texts()

    def compare(self, page: Page) -> Iterator[tuple[int, int, bool]]:
        """(node of the page, node of the reference, same text) for matched nodes with text."""
        texts = page.own_texts()
        for y, x in simple_tree_matching(self.page, page).items():
            if texts[y] or self.texts[x]:
                yield y, x, texts[y] == self.texts[x]


def _references(sources, hosts) -> Iterator[Reference | None]:
    held: dict = {}
    for host, source in zip(hosts, sources, strict=True):
        if host not in held:
            if len(held) > 200:
                held.clear()
            held[host] = Reference(source) if source else None
        yield held[host]


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _median_pages(pages: DataFrame) -> DataFrame:
    """r_host, reference: of each host a page of median length. Stubs and cut-off pages are no
    reference unless most pages are such; counts by length keep a large host in no one group."""
    n = F.length("html")
    by_length = cut(pages.groupBy("host", n.alias("n")).count())
    upto = Window.partitionBy("host").orderBy("n")
    total = Window.partitionBy("host")
    medians = cut(by_length.select("host", "n", F.sum("count").over(upto).alias("upto"), F.sum("count").over(total).alias("pages"))
                  .where(2 * F.col("upto") >= F.col("pages")).groupBy("host").agg(F.min("n").alias("m_n"))
                  .withColumnRenamed("host", "m_host"))
    beside = broadcast_if(medians, F.octet_length("m_host"))
    return (pages.join(beside, (F.col("host") == F.col("m_host")) & (n == F.col("m_n")))
            .groupBy(F.col("host").alias("r_host")).agg(F.min("html").alias("reference")))


def extract_main_text(pages: DataFrame, share: float = 0.8, support: int = 4) -> DataFrame:
    """page_id, url, text of every page.

    A node is template if at least ``support`` pages of the host match it and a ``share`` of
    them has the reference's text there.
    """
    ship(pages.sparkSession)
    pages = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    usable = F.length(F.trim(F.coalesce("html", F.lit("")))) > 0
    references = cut(_median_pages(pages.where(usable)))
    beside = broadcast_if(references, F.octet_length("reference"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = Counter()
            for host, source, ref in zip(b["host"], b["html"], _references(b["reference"], b["host"]), strict=True):
                for _, x, same in ref.compare(Page(source)):
                    seen[host, x, same] += 1
            yield pd.DataFrame([(h, x, n if same else 0, n) for (h, x, same), n in seen.items()],
                               columns=["host", "node", "same", "pages"])

    aligned = pages.where(usable).join(beside, F.col("host") == F.col("r_host")).select("host", "html", "reference")
    slots = (aligned.mapInPandas(count, "host string, node int, same long, pages long")
             .groupBy("host", "node").agg(F.sum("same").alias("same"), F.sum("pages").alias("pages")))
    wrappers = (slots.where((F.col("pages") >= support) & (F.col("same") >= share * F.col("pages")))
                .groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("nodes")))  # one page's nodes at most
    wrappers = cut(references.join(wrappers.withColumnRenamed("host", "w_host"), F.col("r_host") == F.col("w_host")).select(
        "w_host", "reference", F.to_json("nodes").alias("template")))
    beside = broadcast_if(wrappers, F.octet_length("reference") + F.octet_length("template"))

    @F.pandas_udf("string")
    def main_text(html: pd.Series, host: pd.Series, reference: pd.Series, template: pd.Series) -> pd.Series:
        out = []
        for source, ref, nodes in zip(html, _references(reference, host), template, strict=True):
            page, fixed = Page(source), set()
            if ref is not None and nodes:
                constant = set(json.loads(nodes))
                fixed = {y for y, x, same in ref.compare(page) if same and x in constant}
            out.append(page.text(fixed))
        return pd.Series(out, dtype=object)

    return (pages.join(beside, F.col("host") == F.col("w_host"), "left")
            .select("page_id", "url", main_text("html", "host", "reference", "template").alias("text")))
