"""Main text of web pages by wrapper induction.

Pages of a host are parsed into DOM trees, menus, headers and footers included, whose runs of like siblings are folded
into one repeated node with the texts and the children of them all. In groups of a bounded number of pages the folded
trees are aligned one after another with a growing template by simple tree matching; each slot of the template counts
its pages, its characters, links and headings, and on how many pages it has met each text. Over all groups of a host
every slot then gets one verdict, and extraction follows it:

- a text that fills its slot on nearly every page is template, also in a run of siblings or among paragraphs;
- a slot outside the article that holds little but short links is a menu;
- a slot whose tag, class or role names a menu, header, footer, sidebar, notice, advert, form or comment section is
  template as well, unless it is only a class and the slot holds the page's heading and most of the host's text;
- all other slots are content.

Pages with the same text count once, so copies of one article cannot turn it into template. The page's content is its
outermost article or main elements that are not template, or else its body. Hosts with fewer than `least_pages` different
pages have no template; there the names alone decide.

Text: character references decoded, white space in a block becomes one space, blocks trimmed and joined by a newline.
Null html gives an empty text. Pages without a host share one template. Repeated rows each get their row.
"""

from __future__ import annotations

import html
import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seawake.llm.words import cut

# Fixed values of the HTML standard and of common usage.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html dd dt li tbody td tfoot th thead tr summary".split())
HIDDEN = frozenset("head iframe input noscript script select style svg template textarea title".split())
DROPPED = frozenset("aside button dialog footer form menu nav".split())
MARKED = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
SIBLINGS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

TAG = regex.compile(r"""<!--.*?(?:-->|\z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>|<[A-Za-z][^<]*\z""", regex.S)
ATTRIBUTE = regex.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", regex.I)
SPLIT = regex.compile(r"[\s_\-]+")
#: Elements nested deeper are siblings of their parents; no text is lost by that.
DEPTH = 200
#: A host is large with one in so many pages; its rows are then dealt over so many tasks.
LARGE, SALTS = 1000, 64
#: A slot outside the article is a menu with so many links a page, so large a share of text in them, and so short ones.
MENU_LINKS, MENU_SHARE, MENU_CHARS = 3, 0.8, 30
#: Up to so many verdicts are shipped to the tasks; beyond, pages are joined with those of their host by a shuffle.
SHIPPED = 200_000
NUMBER = regex.compile(r"\d+")
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


class Node:
    """An element with its marks and its children, elements and strings."""

    __slots__ = ("children", "marks", "tag")

    def __init__(self, tag: str, marks: str = "") -> None:
        self.tag, self.marks, self.children = tag, marks, []

    def named(self, inside: bool) -> int:
        """2 if the tag says that the element holds no main text, 1 if a class, id or role does, else 0; a header may hold
        some inside an article."""
        if self.tag in DROPPED or self.tag == "header" and not inside:
            return 2
        if not self.marks:
            return 0
        words = {*SPLIT.split(self.marks)}
        return int(bool(words & MARKED) or not inside and "header" in words)

    def main(self) -> bool:
        return self.tag in ("article", "main") or self.marks == "main"

    def step(self, path: str) -> str:
        """The path of the element's slot below that of its parent; numbers in marks do not tell slots apart."""
        return f"{path}/{self.tag}.{NUMBER.sub('0', self.marks)}"


def parse(page: str) -> Node:
    """A tree of any text; unclosed and stray tags are mended as browsers mostly do."""
    root = Node("html")
    open_, at, low = [root], 0, None
    while m := TAG.search(page, at):
        if m.start() > at:
            open_[-1].children.append(page[at : m.start()])
        at, name = m.end(), m[2]
        if not name:
            continue
        tag = name.lower()
        if m[1]:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == tag:
                    del open_[i:]
                    break
            continue
        if tag in ("html", "body") and len(open_) > 1 and any(x.tag == tag for x in open_[1:]):
            continue
        if tag in CLOSES_P:
            _close(open_, "p", ("article", "aside", "div", "li", "main", "section", "td", "th"))
        elif tag in SIBLINGS:
            _close(open_, tag, SIBLINGS[tag])
            if tag in ("dt", "dd"):
                _close(open_, "dd" if tag == "dt" else "dt", ("dl",))
        marks = " ".join(next(filter(None, a.groups()[1:]), "") for a in ATTRIBUTE.finditer(m[3])).lower() if "=" in m[3] else ""
        node = Node(tag, marks)
        open_[-1].children.append(node)
        if tag in RAW:
            low = low or page.lower()
            end = low.find(f"</{tag}", at) if len(low) == len(page) else regex.compile(f"</{tag}", regex.I).search(page, at).start() if regex.search(f"(?i)</{tag}", page, pos=at) else -1
            at = len(page) if end < 0 else end
        elif tag not in VOID and (tag in BLOCK or not m[3].endswith("/")) and len(open_) < DEPTH:
            open_.append(node)
    if at < len(page):
        open_[-1].children.append(page[at:])
    return root


def _close(open_: list[Node], tag: str, walls: tuple[str, ...]) -> None:
    for i in range(len(open_) - 1, 0, -1):
        if open_[i].tag == tag:
            del open_[i:]
            return
        if open_[i].tag in walls:
            return


class Fold:
    """A folded node: its slot's path, its name's verdict, its own texts, folded children, and the characters, those in
    links, links and whether there is a main heading, all of its subtree."""

    __slots__ = ("chars", "children", "heading", "linked", "links", "name", "path", "texts")

    def __init__(self, path: str, name: int) -> None:
        self.path, self.name, self.texts, self.children = path, name, [], []
        self.chars = self.linked = self.links = self.heading = 0

    def plain(self) -> list:
        """What `unplain` reads."""
        return [self.path, self.name, self.texts, [c.plain() for c in self.children], self.chars, self.linked, self.links, self.heading]

    def add(self, other: Fold) -> None:
        self.chars += other.chars
        self.linked += other.linked
        self.links += other.links
        self.heading |= other.heading


def unplain(x: list) -> Fold:
    f = Fold(x[0], x[1])
    f.texts, f.children = x[2], [unplain(c) for c in x[3]]
    f.chars, f.linked, f.links, f.heading = x[4:]
    return f


def own(node: Node, inside: bool) -> tuple[str, list[Node], int, int]:
    """An element's own text, inline elements counted as text, its inner slots (block elements and named inline ones), and
    the characters and number of its own links."""
    text: list[str] = []
    slots: list[Node] = []
    linked = links = 0
    stack: list[tuple[Node | str, bool]] = [(c, node.tag == "a") for c in reversed(node.children)]
    while stack:
        c, link = stack.pop()
        if isinstance(c, str):
            text.append(c)
            linked += len(c) * link
        elif c.tag in HIDDEN:
            continue
        elif c.tag in BLOCK or c.named(inside):
            slots.append(c)
        else:
            links += c.tag == "a"
            stack += [(x, link or c.tag == "a") for x in reversed(c.children)]
    return " ".join("".join(text).split()), slots, linked, links


def digest(words: str) -> str:
    return xxhash.xxh64_hexdigest(words) if words else ""


def fold(node: Node, inside: bool = False, path: str = "") -> Fold:
    """A subtree with each run of like siblings as one repeated node, which has the texts and the children of them all."""
    name = node.named(inside)
    inside |= node.main()
    f = Fold(node.step(path), name)
    words, slots, f.linked, f.links = own(node, inside)
    f.chars, f.heading = len(words), int(node.tag == "h1" and bool(words))
    if words:
        f.texts.append(digest(words))
    for c in slots:
        inner = fold(c, inside, f.path)
        f.add(inner)
        if f.children and f.children[-1].path == inner.path:
            _unite(f.children[-1], inner)
        else:
            f.children.append(inner)
    return f


def _unite(a: Fold, b: Fold) -> None:
    """Adds a folded sibling `b` to `a`: its texts, and each of its children to a like one, in order where there is one."""
    a.add(b)
    a.texts.extend(b.texts)
    at = 0
    for child in b.children:
        like = [i for i, x in enumerate(a.children) if x.path == child.path]
        if not like:
            a.children.insert(at, child)
            at += 1
            continue
        i = next((i for i in like if i >= at), like[-1])
        _unite(a.children[i], child)
        at = max(at, i + 1)


def content_key(f: Fold) -> str:
    """A hash of the texts that are not in named slots, of those in the article if there are any."""
    inner: list[str] = []
    outer: list[str] = []

    def walk(x: Fold, inside: bool) -> None:
        if not x.name:
            inside = inside or in_main(x.path)
            (inner if inside else outer).extend(x.texts)
            for c in x.children:
                walk(c, inside)

    walk(f, False)
    return digest(" ".join(inner or outer))


def in_main(path: str) -> bool:
    return "/article." in path or "/main." in path or path.endswith(".main") or ".main/" in path


class Slot:
    """A template node: how many pages have it, how often each text filled it, and the sums of its subtrees."""

    __slots__ = ("children", "name", "pages", "path", "sums", "texts")

    def __init__(self, path: str, name: int) -> None:
        self.path, self.name, self.pages, self.texts, self.children, self.sums = path, name, 0, Counter(), [], [0, 0, 0, 0]


def matching(a: Slot, b: Fold) -> int:
    """Simple tree matching: the size of the largest match that keeps order and depth."""
    if a.path != b.path:
        return 0
    return 1 + _align(a.children, b.children)[0]


def _align(a: list[Slot], b: list[Fold]) -> tuple[int, list[tuple[int, int]]]:
    weight = [[matching(x, y) for y in b] for x in a]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + weight[i][j] if weight[i][j] else 0)
    pairs, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if weight[i][j] and best[i][j] == best[i + 1][j + 1] + weight[i][j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return best[0][0], pairs


def merge(slot: Slot, tree: Fold) -> None:
    """Counts a page's folded tree in the template; what has no counterpart becomes a new slot."""
    slot.pages += 1
    slot.texts.update({*tree.texts})
    slot.sums = [x + y for x, y in zip(slot.sums, (tree.chars, tree.linked, tree.links, tree.heading), strict=True)]
    if len(slot.children) == len(tree.children) and all(x.path == y.path for x, y in zip(slot.children, tree.children, strict=True)):
        partner = dict(enumerate(slot.children))  # the best match there can be
    else:
        partner = {j: slot.children[i] for i, j in _align(slot.children, tree.children)[1]}
    at = 0
    for j, child in enumerate(tree.children):
        if j not in partner:
            partner[j] = Slot(child.path, child.name)
            slot.children.insert(at, partner[j])
        at = slot.children.index(partner[j], at) + 1
        merge(partner[j], child)


def _slots(slot: Slot) -> Iterator[tuple]:
    """(path, name, text hash, pages with this text, pages with the slot, sums) for each slot, with no text, and each of
    its texts."""
    yield slot.path, slot.name, "", 0, slot.pages, *slot.sums
    yield from ((slot.path, slot.name, text, n, slot.pages, 0, 0, 0, 0) for text, n in slot.texts.items())
    for c in slot.children:
        yield from _slots(c)


class Verdicts:
    """The template slots of a host, and the texts (path, hash) that are template in slots of content."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        self.slots = {path for path, text in rows if not text}
        self.texts = {(path, text) for path, text in rows if text}


def text_of(page: str | None, verdicts: Verdicts | None = None) -> str:
    """The main text of a page under the verdicts of its host's template; without them, by names."""
    if not page:
        return ""
    tree = parse(page)
    blocks: list[str] = []
    run: list[str] = []

    def gone(node: Node, inside: bool, path: str) -> bool:
        return node.tag in HIDDEN or (bool(node.named(inside)) if verdicts is None else path in verdicts.slots)

    def roots() -> list[tuple[Node, str]]:
        """The outermost article or main elements that are not template, or else the tree, with their paths."""
        found: list[tuple[Node, str]] = []
        stack = [(tree, tree.step(""))]
        while stack:
            x, path = stack.pop()
            if x.main():
                found.append((x, path))
                continue
            inner = [(c, c.step(path) if c.tag in BLOCK or c.named(False) else path) for c in x.children if isinstance(c, Node)]
            stack += reversed([(c, p) for c, p in inner if not gone(c, False, p if p != path else "")])
        return found or [(tree, tree.step(""))]

    def end() -> None:
        if words := " ".join(html.unescape("".join(run)).split()):
            blocks.append(words)
        run.clear()

    def walk(node: Node, inside: bool, path: str) -> None:
        if verdicts is not None and verdicts.texts:
            words, inner, _, _ = own(node, inside)
            if not inner and (path, digest(words)) in verdicts.texts:
                return
        stack = list(reversed(node.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                run.append(c)
            elif c.tag in ("br", "wbr"):
                run.append(" ")
            elif c.tag in BLOCK or c.tag in HIDDEN or c.named(inside):
                below = c.step(path)
                if gone(c, inside, below):
                    continue
                if c.tag in BLOCK:
                    end()
                walk(c, inside or c.main(), below)
                if c.tag in BLOCK:
                    end()
            else:
                stack += reversed(c.children)

    for node, path in roots():
        walk(node, node.main(), path)
        end()
    return "\n".join(blocks)


HOSTED, DEALT, FOUND = "the host", "the salt", "the verdicts"


def large_hosts(pages: DataFrame) -> list[str]:
    """The hosts with at least one in `LARGE` of all pages; so there are no more than `LARGE` of them."""
    sizes = cut(pages.groupBy(HOSTED).count())
    total = sizes.agg(F.sum("count")).first()[0] or 0
    return [r[0] for r in sizes.filter(F.col("count") * LARGE >= total).select(HOSTED).collect()]


def _join_host(rows: DataFrame, by_host: DataFrame, large: list[str], deal: Column, how: str) -> DataFrame:
    """Joins `by_host`, which has a row for each host, by host; rows of large hosts are dealt over `SALTS` tasks by `deal`."""
    salted = rows.withColumn(DEALT, F.when(F.col(HOSTED).isin(large), F.pmod(deal, F.lit(SALTS))).otherwise(0).cast("int"))
    salts = F.when(F.col(HOSTED).isin(large), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(by_host.withColumn(DEALT, F.explode(salts)), [HOSTED, DEALT], how).drop(DEALT)


def templates(pages: DataFrame, large: list[str], *, group_pages: int = 32, least_pages: int = 8, share: float = 0.8) -> DataFrame:
    """(the host, path, text): for each host with a template its template slots, without a text, and the texts that are
    template in slots of content. A host without either has one row without path and text.

    Every page takes part. A host's pages are dealt into groups of about `group_pages`, so a host of any size is spread
    over many tasks; their counts are summed per slot.
    """

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = [fold(parse(t or "")) for t in batch.column(1).to_pylist()]
            found = [json.dumps(f.plain(), separators=(",", ":")) for f in folds]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(content_key, folds), pa.string()), pa.array(found, pa.string())], [HOSTED, "content", "tree"])

    folded = pages.select(HOSTED, "html").mapInArrow(trees, f"`{HOSTED}` string, content string, tree string")
    folded = cut(folded.groupBy(HOSTED, "content").agg(F.min("tree").alias("tree")))
    sizes = cut(folded.groupBy(HOSTED).count().filter(F.col("count") >= least_pages))
    dealt = _join_host(folded, sizes, large, F.xxhash64("tree"), "inner").withColumn("part", F.pmod(F.xxhash64("tree"), F.ceil(F.col("count") / group_pages)))
    schema = f"`{HOSTED}` string, path string, name int, text string, n long, pages long, chars long, linked long, links long, headings long"

    def align(group: pd.DataFrame) -> pd.DataFrame:
        top: Slot | None = None
        for t in group.tree:
            tree = unplain(json.loads(t))
            top = top or Slot(tree.path, tree.name)
            merge(top, tree)
        rows = [(group[HOSTED].iloc[0], *x) for x in _slots(top)]
        return pd.DataFrame(rows, columns=[HOSTED, "path", "name", "text", "n", "pages", "chars", "linked", "links", "headings"])

    counted = dealt.groupBy(HOSTED, "part").applyInPandas(align, schema)
    sums = [F.sum(c).alias(c) for c in ("n", "pages", "chars", "linked", "links", "headings")]
    summed = cut(counted.groupBy(HOSTED, "path", "text").agg(F.max("name").alias("name"), *sums))
    whole = summed.filter(F.col("text") == "").groupBy(HOSTED).agg(F.max("chars").alias("whole"))
    slots = summed.filter(F.col("text") == "").join(whole, HOSTED)
    body = (F.col("name") == 1) & (F.col("headings") >= share * F.col("pages")) & (2 * F.col("chars") > F.col("whole")) & (2 * F.col("linked") < F.col("chars"))
    inside = F.col("path").contains("/article.") | F.col("path").contains("/main.") | F.col("path").contains(".main/") | F.col("path").endswith(".main")
    menu = ~inside & (F.col("links") >= MENU_LINKS * F.col("pages")) & (F.col("linked") >= MENU_SHARE * F.col("chars")) & (F.col("chars") <= MENU_CHARS * F.col("links"))
    often = (F.col("n") >= least_pages) & (F.col("n") >= share * F.col("pages"))  # in the slots that it fills
    fixed = summed.filter((F.col("text") != "") & often).join(sizes, HOSTED).filter(F.col("n") >= share / 2 * F.col("count"))  # and on the host
    found = slots.filter((F.col("name") > 0) & ~body | menu).select(HOSTED, "path", "text").unionByName(fixed.select(HOSTED, "path", "text"))
    none = F.lit(None).cast("string")
    return found.unionByName(sizes.select(HOSTED, none.alias("path"), none.alias("text")))


def extract(pages: DataFrame, *, group_pages: int = 32, least_pages: int = 8, share: float = 0.8) -> DataFrame:
    """`pages` with a column `text`, which replaces one of that name; all other columns stay."""
    pages = pages.drop("text")
    hosted = pages.withColumn(HOSTED, F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")))
    large = large_hosts(hosted)
    found = cut(templates(hosted, large, group_pages=group_pages, least_pages=least_pages, share=share))
    at, names, n = pages.columns.index("html"), [*pages.columns, "text"], len(pages.columns)
    shipped: dict[str, Verdicts] | None = None
    if found.count() <= SHIPPED:
        rows: dict[str, list[tuple[str, str]]] = {}
        for host, path, text in zip(*(c.to_pylist() for c in found.toArrow().columns), strict=True):
            rows.setdefault(host, []).extend([(path, text)] if path is not None else [])
        shipped, joined = {host: Verdicts(x) for host, x in rows.items()}, hosted
    else:
        by_host = found.groupBy(HOSTED).agg(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("path", "text"))).alias(FOUND))
        joined = _join_host(hosted, by_host, large, F.monotonically_increasing_id(), "left").select(*pages.columns, HOSTED, FOUND)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = batch.column(n).to_pylist()
            if shipped is None:
                known: dict[str, Verdicts] = {}
                for host, some in zip(hosts, batch.column(n + 1), strict=True):
                    if host not in known and some.is_valid:
                        known[host] = Verdicts([(x["path"], x["text"]) for x in some.as_py()])
            else:
                known = shipped
            texts = [text_of(page, known.get(host)) for page, host in zip(batch.column(at).to_pylist(), hosts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], names)

    return joined.mapInArrow(task, T.StructType([*pages.schema.fields, T.StructField("text", T.StringType())]))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its length in code points."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
