"""Main text of web pages from templates deduced across the pages of a host."""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.session import stored

# Fixed values of the markup.
RAW = {"script", "style", "noscript", "template", "iframe", "noembed", "noframes", "textarea", "title", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
CONTAINERS = {"body", "article", "main", "section", "div", "td", "center"}
CHROME_TAGS = {
    "head", "nav", "aside", "footer", "form", "menu", "dialog", "svg", "math", "object", "canvas", "audio", "video", "select", "button", "fieldset",
}
CHROME_NAMES = {
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "sidebars", "aside", "footer", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
    "search", "comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "share", "sharing", "social", "related",
    "recommended", "recommendations", "widget", "toolbar", "pagination", "pager", "skip",
}
HEAD_NAMES = {"header", "masthead", "topbar"}
# End of the fixed values.

CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
DEPTH = 30  # levels that a path tells apart; deeper elements share the path of that level
SHARE = 0.1  # of a host's pages that a template token occurs on at least
TIE = 0.25  # of the text of the largest slot beside it that an article or main element must hold to be taken for the article
NAMED_CHROME, TAG_CHROME = 1, 2  # an element around is no article text by its class, id or role; by its tag


class Element:
    __slots__ = ("tag", "path", "chrome", "article")

    def __init__(self, tag: str, path: str, chrome: int, article: bool):
        self.tag, self.path, self.chrome, self.article = tag, path, chrome, article


def blocks(page: str) -> tuple[list[tuple[str, int, str, int]], Counter]:
    """Text blocks of a page in order, and how often every element path opens.

    A block is (path of its element, 0 or what says that it is no article text:
    NAMED_CHROME or TAG_CHROME, text with references decoded and white space as
    single blanks, how many of its characters are links). Unclosed elements are closed
    as browsers do for paragraphs, list items and table cells.
    """
    found, opened = [], Counter({"": 1})
    root = Element("", "", 0, False)
    stack, words, links, in_link = [root], [], 0, False

    def flush():
        nonlocal links
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            if text:
                found.append((stack[-1].path, stack[-1].chrome, text, min(links, len(text))))
            words.clear()
        links = 0

    def add(text: str):
        nonlocal links
        words.append(text)
        if in_link:
            links += len(text)

    at, end = 0, len(page)
    while at < end:
        mark = MARK.search(page, at)
        if mark is None:
            add(page[at:])
            break
        if mark.start() > at:
            add(page[at : mark.start()])
        at = mark.end()
        if mark[2] is None:
            continue
        tag, closing = mark[2].lower(), mark[1]
        if tag in RAW:
            if not closing:
                stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag == "br" or tag == "wbr":
            words.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            continue
        flush()
        in_link = False
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
            continue
        if tag in VOID:
            continue
        if stack[-1].tag == "p":
            stack.pop()
        if tag in CLOSES:
            while stack[-1].tag in CLOSES[tag]:
                stack.pop()
        above = stack[-1]
        named = {name.lower(): (a or b or c) for name, a, b, c in NAMED.findall(mark[3])} if mark[3] else {}
        names = set(re.split(r"[^a-z0-9]+", " ".join(named.values()).lower()))
        article = above.article or tag in ("article", "main")
        chrome = above.chrome
        if tag in CHROME_TAGS or (tag == "header" and not article):
            chrome = TAG_CHROME
        elif (names & CHROME_NAMES and tag not in ("body", "html", "article", "main")) or (names & HEAD_NAMES and not article):
            chrome = max(chrome, NAMED_CHROME)
        step = tag
        if named.get("class", "").split():
            step += "." + named["class"].split()[0]
        elif named.get("id"):
            step += "#" + named["id"]
        step = tag + re.sub(r"\d+", "0", step[len(tag) :].replace("/", ""))[:60]
        path = above.path if above.path.count("/") >= DEPTH else f"{above.path}/{step}"
        opened[path] += 1
        stack.append(Element(tag, path, chrome, article))
    flush()
    return found, opened


def host_of(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def token_stats(pages: DataFrame) -> DataFrame:
    """Per host and element path: pages, occurrences, occurrence vector, and text statistics.

    The occurrence vector of a token over a host's pages is kept as the sum of
    page hash times count: equal vectors have equal sums and others differ but
    by an accident of 64 bits. So a host with a third of all pages is added up
    on the map side like any other.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, key, page in zip(batch["host"], batch["key"], batch["html"], strict=True):
                found, opened = blocks(page)
                texts: dict[str, list] = {}
                for path, chrome, text, links in found:
                    entry = texts.setdefault(path, [0, 0, chrome, []])
                    entry[0] += len(text)
                    entry[1] += links
                    entry[3].append(text)
                for path, count in opened.items():
                    chars, links, chrome, parts = texts.pop(path, (0, 0, 0, []))
                    rows.append((host, path, key, 1, count, chars, links, chrome, "\n".join(parts), parts[0] if parts else ""))
                    # Further blocks of the path have a row each, for how many of them differ.
                    rows.extend((host, path, key, 0, 0, 0, 0, 0, "", part) for part in parts[1:])
            out = pd.DataFrame(rows, columns=["host", "path", "key", "page", "n", "chars", "links", "chrome", "text", "block"])
            out["said"] = (out["block"] != "").astype(np.int32)
            for name in ("text", "block"):
                out[name] = pd.util.hash_array(out[name].to_numpy(dtype=object)).astype(np.int64)
            yield out

    rows = pages.select(host_of("url").alias("host"), F.xxhash64("page_id", "url", "html").alias("key"), F.coalesce("html", F.lit("")).alias("html"))
    tokens = rows.mapInPandas(read, "host string, path string, key long, page int, n int, chars long, links long, chrome int, text long, block long, said int")
    # Wrapping products and sums of 64 bits; decimal sums keep them exact without overflow errors.
    weighed = (F.col("key").cast("decimal(20,0)") * F.col("n")).cast("decimal(32,0)")
    return tokens.groupBy("host", "path").agg(
        F.sum("page").alias("pages"),
        F.sum("n").alias("total"),
        F.sum(weighed).cast("string").alias("vector"),
        F.sum("chars").alias("chars"),
        F.sum("links").alias("links"),
        F.max("chrome").alias("chrome"),
        F.approx_count_distinct(F.when(F.col("page") == 1, F.col("text"))).alias("texts"),
        F.sum("said").alias("blocks"),
        F.approx_count_distinct(F.when(F.col("said") == 1, F.col("block"))).alias("distinct"),
    )


def tag_of(path: str) -> str:
    return re.split(r"[.#]", path.rpartition("/")[2])[0]


def above(path: str) -> Iterator[str]:
    """The path and all paths around it, the whole page ('') last."""
    while path:
        yield path
        path = path.rpartition("/")[0]
    yield ""


Token = tuple[int, int, bool, float, bool]  # class, parent, once on every page that has it, article characters a page, other


def article_slot(template: dict[str, Token], present: Iterable[str]) -> tuple[str | None, set[str]]:
    """Article slot of the layout with these tokens (None: no varying text), and the paths that are no article text there.

    A page's layout is the valid tokens that it has. A class is page-level if
    all its tokens are once on every page that has them; its tokens, told apart
    by the class around them, and the whole page are the slots of the template,
    and text lies in the slot of the nearest one. The class whose slots hold
    most of the varying text has the article: its deepest container with half
    of that text, or a container around that adds text of its own alone, such as
    a heading. An article or main element only breaks near ties: it is taken if
    it is a slot with at least a quarter (`TIE`) of the text of any slot beside it. Inside the article
    slot, page-level containers whose text is all in containers that repeat
    (records) and less than half of the article's are lists beside it:
    comments, cards, teasers.
    """
    tokens = {p: template[p] for p in present if p in template}
    level: dict[int, bool] = {}
    for number, _, once, _, _ in tokens.values():
        level[number] = level.get(number, True) and once
    places = {p for p, t in tokens.items() if p == "" or level[t[0]]}
    mass, direct, records, by_class, of_class = Counter(), Counter(), Counter(), Counter(), Counter()
    for path, (_, _, _, chars, other) in tokens.items():
        if not chars or other:
            continue
        kind = next(tokens[p][:2] for p in above(path) if p in places)
        by_class[kind] += chars
        direct[next(p for p in above(path) if p == "" or tag_of(p) in CONTAINERS)] += chars
        record = False
        for up in above(path):
            mass[up] += chars
            of_class[up, kind] += chars
            records[up] += chars if record else 0
            record |= up in tokens and up not in places and tag_of(up) in CONTAINERS
    others = {p for p, t in tokens.items() if t[4]}
    if not by_class:
        return None, others
    slots = [p for p in places if mass[p] > 0 and (p == "" or tag_of(p) in CONTAINERS)]
    kind = max(by_class, key=lambda c: (by_class[c], c))

    def largest_beside(path: str) -> float:
        return max((mass[p] for p in slots if not f"{p}/".startswith(f"{path}/") and not f"{path}/".startswith(f"{p}/")), default=0)

    own = [p for p in slots if tag_of(p) in ("article", "main") and mass[p] >= TIE * largest_beside(p)]
    if own:
        most = max(mass[p] for p in own)
        main = max((p for p in own if 2 * mass[p] >= most), key=lambda p: (p.count("/"), mass[p], p))
    else:
        main = max((p for p in slots if 2 * of_class[p, kind] >= by_class[kind]), key=lambda p: (p.count("/"), mass[p], p), default="")
        for up in list(above(main))[1:]:
            added = mass[up] - mass[main]
            if tag_of(up) in ("", "html", "body") or up not in places or added > direct[up] + 1e-9 * mass[up]:
                break
            if added > 0 and tag_of(up) in CONTAINERS:
                main = up
    beside = {p for p in slots if p.startswith(main + "/") and records[p] > 0.999 * mass[p] and 2 * mass[p] < mass[main]}
    return main, others | {p for p in tokens if not beside.isdisjoint(above(p))}


def template_of(rows: pd.DataFrame) -> pd.DataFrame:
    """Template of one host: its tokens by class, the class around each, and what each token's slot holds."""
    rows = rows.sort_values("path").reset_index(drop=True)
    host_pages = int(rows.loc[rows["path"] == "", "pages"].max())
    rows["class"] = rows.groupby("vector").ngroup()
    by_path = dict(zip(rows["path"], rows["class"], strict=True))

    def parent(path: str) -> int:
        own = by_path[path]
        while path:
            path = path.rpartition("/")[0]
            if by_path.get(path, own) != own:
                return by_path[path]
        return -1

    rows["parent"] = [parent(p) for p in rows["path"]]
    rows["once"] = rows["pages"] == rows["total"]
    tagged = rows["chrome"] == TAG_CHROME
    varied = int(rows.loc[~tagged, "texts"].max())

    def in_article(path: str) -> bool:
        """Whether the nearest container is the article or main element: the page itself calls the text its article."""
        return next((tag_of(p) for p in above(path) if tag_of(p) in CONTAINERS), "") in ("article", "main")

    # A slot that says the same on many pages whose other text differs is the template's own words, and
    # one whose blocks come again on other pages is a list of what else the host has, unless
    # such slots hold most of the host's text: then its articles are copies of each other.
    many = ~rows["path"].map(in_article) & (rows["pages"] >= 5) & (varied >= 5) & (rows["chars"] > 0)
    own_words = many & (rows["texts"] <= 1)
    again = many & ~own_words & (rows["distinct"] * 2 <= rows["blocks"])
    prose = (rows["chars"] - rows["links"]).where(~tagged & ~own_words, 0)
    constant = own_words | (again & (2 * prose[again].sum() <= prose.sum()))
    link_list = (rows["links"] * 2 > rows["chars"]) & (rows["pages"] >= 2) & ~rows["path"].map(tag_of).isin(["p", "h1", "h2", "h3", "body"])
    rows["other"] = tagged | constant | link_list
    rows["mass"] = np.where(rows["other"], 0, rows["chars"] - rows["links"]) / rows["pages"]
    template = {p: (c, q, o, m, x) for p, c, q, o, m, x in rows[["path", "class", "parent", "once", "mass", "other"]].itertuples(index=False)}
    main, others = article_slot(template, rows.loc[rows["pages"] * 2 >= host_pages, "path"])
    rows["slot"] = ["main" if main in above(p) and p not in others and not template[p][4] else "other" for p in rows["path"]]
    rows["main"] = main or ""
    return rows[["host", "path", "class", "parent", "pages", "total", "slot", "main", "once", "mass", "other"]]


TEMPLATE = "host string, path string, class int, parent int, pages long, total long, slot string, main string, once boolean, mass double, other boolean"


def templates(pages: DataFrame) -> DataFrame:
    """Templates of all hosts with at least two pages: host, path, class, parent, pages, total, slot, main, once, mass, other.

    Tokens are element paths. Tokens with equal occurrence vectors over the
    host's pages form a class; classes on at least a tenth of the pages (two
    at least) are valid and nest by the paths of their tokens (`parent`, -1 at the top).
    Each token is the start of a slot: `once` says whether it is a page-level
    one, `mass` how much varying text of its own a page has there, `other` that
    it holds the template's words, links or what tags call no article. From
    these every page's layout gets its article slot (`article_slot`); `main`
    and `slot` are that of the layout of tokens on at least half of the pages.
    A page has few tokens and rare ones are dropped before grouping, so a
    host's group is about ten pages' worth of tokens.
    """
    stats = stored(token_stats(pages), "tokens")
    sizes = stats.where("path = ''").select("host", F.col("pages").alias("host_pages")).where("host_pages > 1")
    valid = stats.join(sizes, "host").where((F.col("pages") >= 2) & (F.col("pages") >= F.col("host_pages") * SHARE)).drop("host_pages")
    return valid.groupBy("host").applyInPandas(template_of, TEMPLATE)


def main_text(page: str, template: dict[str, Token] | None, layouts: dict) -> str:
    """Blocks in the article slot of the page's layout; without such a slot, in its article, main element or body.

    Names of classes count only there. `layouts` keeps the slots of layouts seen before.
    """
    found, opened = blocks(page)
    others: set[str] = set()
    if template:
        layout = frozenset(p for p in opened if p in template)
        if layout not in layouts:
            layouts[layout] = article_slot(template, layout)
        main, others = layouts[layout]
        if main is not None:
            picked = [text for path, chrome, text, _ in found if chrome != TAG_CHROME and path not in others and (path == main or path.startswith(main + "/"))]
            if picked:
                return "\n".join(picked)
    good = [(path, text) for path, chrome, text, _ in found if not chrome and path not in others]
    for name in ("article", "main"):
        picked = [text for path, text in good if any(tag_of(part) == name for part in path.split("/"))]
        if picked:
            return "\n".join(picked)
    return "\n".join(text for _, text in good)


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    Templates are joined to the pages by host; the table has one row per host,
    which Spark sends to all tasks where it is small and joins by sort and
    split of skewed hosts where it is not. A null html is an empty page, a
    null or odd url belongs to the host ''. Hosts with a single page have no
    template; their pages go by element names. Repeated rows are extracted
    each; other columns are not looked at; no pages give no rows.
    """
    token = F.struct("path", "class", "parent", "once", "mass", "other")
    plan = stored(templates(pages).groupBy("host").agg(F.to_json(F.collect_list(token)).alias("template")), "templates").withColumnRenamed("host", "of_host")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of("url").alias("host"))
    joined = rows.join(plan, rows["host"] == plan["of_host"], "left").select("page_id", "url", "html", "template")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: dict[str | None, tuple] = {None: (None, {})}
            texts = []
            for page, said in zip(batch["html"], batch["template"], strict=True):
                if said not in known:
                    known[said] = ({t["path"]: (t["class"], t["parent"], t["once"], t["mass"], t["other"]) for t in json.loads(said)}, {})
                texts.append(main_text(page, *known[said]))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    # Ids travel as text, since pandas turns whole numbers beside nulls into floats.
    out = joined.withColumn("page_id", F.col("page_id").cast("string")).mapInPandas(cut, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))
