"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its elements, named by their path of block elements
(class and id included, digits levelled), and its text blocks, named by path and
text. A token's occurrence vector over the distinct pages of a host is folded to
a commutative hash of (page, count), so equal vectors meet in a group-by without
any host's pages being gathered, however many it has.

1. Tokens of a host with equal vectors form an equivalence class. Classes that
   are frequent (on ``SUPPORT`` of the host's pages, or on ``ENOUGH_PAGES`` of them, so that a layout of a large host
   has a template too) and large (``CLASS_SIZE`` tokens) are template parts; a class is valid where its tokens hang below
   tokens of valid classes, from the document's root down.
2. Valid classes nest by these paths into the template. Its element tokens open
   slots. The content slots are its article elements, for a page without any its main
   elements; without those, the smallest element that holds ``CONTENT_SHARE`` of the host's text.
3. A text token in the same class as the element around it is constant: template
   text and no data (from ``TEXT_PAGES`` pages and ``TEXT_ARTICLES`` different
   article texts on). A slot that is nearly all links is a menu.
4. What remains in the content slots of a page is its text. Elements of the kinds
   that never hold the article (navigation, hidden ones ...) are left out by name, also
   where a host has too few pages for a template; there the page's own article,
   main or body is the content. A form is left out unless it holds ``CONTENT_SHARE`` of the page's text.
5. The slots decide before the list of class words (adverts, comments ...): it
   takes out elements beside or below a slot, never one around it, html, body,
   main or article, one that holds the page's only articles or mains, or one with
   ``CONTENT_SHARE`` of the text. An article within an article is a comment to it, and taken out likewise.

Only block elements part texts: all others, known or not, run on. Work is linear in
the page, however deep its elements nest. Without rows the result is empty.

Null html gives the empty text, a null or odd url the empty host. Rows are
extracted one by one; copies of a page count as one page of their host in the
template, which is then applied to each of them.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitals.llm.blocks import bounded_batches, text_blocks, utf8_list, written

SUPPORT = 0.05
ENOUGH_PAGES = 50
MIN_PAGES = 3
CLASS_SIZE = 2
CONTENT_SHARE = 0.6
LINK_SHARE = 0.8
TEXT_PAGES = 10
TEXT_ARTICLES = 5

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*)*+)(?:>|\Z)""",
    re.S)
# a name and its value, or a quoted string without a name, so that no name is looked for within a value
_ATTR = re.compile(r"""([^\s"'=>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
_SPLIT = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"\d+")
_HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)")

# fixed values: HTML element kinds
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"hr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "col", "colgroup", "dd", "details",
         "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2",
         "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol",
         "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
         "tr", "ul"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
NOT_CONTENT = {"head", "nav", "footer", "aside", "dialog", "menu"}
SKIPPED = {"button", "select", "svg", "canvas", "object", "audio", "video", "template", "map", "datalist"}
NOT_CONTENT_WORDS = {
    "ad", "ads", "advert", "advertisement", "adverts", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "cookie", "cookies", "disclaimer", "disqus", "footer", "login", "menu", "modal", "nav",
    "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "related",
    "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe",
    "widget", "contentinfo", "complementary", "alert", "replies", "responses", "discussion"}
WHOLE = {"html", "body", "main", "article"}

ROOT = 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Page:
    """Element tokens and text blocks of one page.

    ``tokens``: key -> [parent, name, outside, count, chars, link chars], parents first, where
    ``outside`` says that the element or one around it never holds the article.
    ``blocks``: (key of the innermost element, outside, text) in page order.
    ``listed``: keys of the elements that the word list takes out where no slot
    says otherwise.
    """

    def __init__(self, source: str):
        self.tokens: dict[int, list] = {ROOT: [ROOT, "", False, 1, 0, 0]}
        self.blocks: list[tuple[int, bool, str]] = []
        # name, key, outside, whether its text is skipped; those that are skipped part no text
        self._stack: list[tuple[str, int, bool, bool]] = [("", ROOT, False, False)]
        self._open_names: dict[str, int] = defaultdict(int)
        self._text: list[str] = []
        self._links = 0
        self._in_link = 0
        self._worded: set[int] = set()
        self._nested: set[int] = set()
        self._forms: set[int] = set()
        self._parse(source)
        # what an element holds is in the elements around it too
        for key, token in reversed(self.tokens.items()):
            if key != ROOT:
                self.tokens[token[0]][4] += token[4]
                self.tokens[token[0]][5] += token[5]
        enough = CONTENT_SHARE * self.tokens[ROOT][4]
        out = {k for k in self._forms if self.tokens[k][4] < enough}
        if out:
            for key, token in self.tokens.items():
                token[2] = token[2] or key in out or self.tokens[token[0]][2]
            self.blocks = [(k, self.tokens[k][2] or o, t) for k, o, t in self.blocks]
        self.listed = self._listed()

    def _flush(self) -> None:
        if not self._text:
            return
        text = " ".join(html.unescape("".join(self._text)).split())
        if text:
            _, key, outside, _ = next(e for e in reversed(self._stack) if not e[3])
            self.tokens[key][4] += len(text)
            self.tokens[key][5] += min(self._links, len(text))
            self.blocks.append((key, outside, text))
        self._text, self._links = [], 0

    def _add(self, text: str) -> None:
        if text and not self._stack[-1][3]:
            self._text.append(text)
            if self._in_link:
                self._links += len(text)

    def _push(self, name: str, key: int, outside: bool, skipped: bool) -> None:
        self._stack.append((name, key, outside, skipped))
        self._open_names[name] += 1

    def _pop(self) -> None:
        self._open_names[self._stack.pop()[0]] -= 1

    def _open(self, name: str, attrs: str) -> None:
        sig, words, hidden = name, set(), False
        if attrs.strip():
            found = {}
            for key, value in _ATTR.findall(attrs):
                found.setdefault(key.lower(), value.strip("\"'").lower())
            hidden = "hidden" in found or bool(_HIDING.search(found.get("style", "")))
            named = [found[k] for k in ("class", "id", "role") if found.get(k)]
            words = {w for v in named for w in _SPLIT.split(v)}
            sig = ".".join([name, *(_DIGITS.sub("0", v) for v in named)])
        _, parent, outside, skipped = self._stack[-1]
        # a header outside an article is the site's
        outside = (outside or skipped or hidden or name in NOT_CONTENT
                   or (name == "header" and not self._open_names["article"] and not self._open_names["main"]))
        key = _signed(xxhash.xxh64_intdigest(sig.encode(), parent & 0xFFFFFFFFFFFFFFFF))
        token = self.tokens.setdefault(key, [parent, name, outside, 0, 0, 0])
        token[3] += 1
        if words & NOT_CONTENT_WORDS:
            self._worded.add(key)
        if name == "article" and self._open_names["article"]:
            self._nested.add(key)
        if name == "form":
            self._forms.add(key)
        if name not in VOID:
            self._push(name, key, outside, skipped)

    def _close(self, name: str) -> None:
        if self._open_names[name]:
            while self._stack[-1][0] != name:
                self._pop()
            self._pop()

    def _parse(self, source: str) -> None:
        at = 0
        while True:
            m = _TAG.search(source, at)
            if m is None:
                self._add(source[at:])
                break
            self._add(source[at:m.start()])
            at = m.end()
            if m[2] is None:
                continue
            end, name, attrs = bool(m[1]), m[2].lower(), m[3]
            if name == "br":
                self._add(" ")
            elif name in RAW:
                if not end and not attrs.endswith("/"):
                    close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                    at = close.end() if close else len(source)
            elif name in SKIPPED:
                if not end and not attrs.endswith("/"):
                    _, key, outside, _ = self._stack[-1]
                    self._push(name, key, outside, True)
                elif end and self._stack[-1][0] == name:
                    self._pop()
                elif end and self._open_names[name]:
                    self._flush()
                    self._close(name)
            elif name not in BLOCK:
                if name == "a":
                    self._in_link = 0 if end else 1
            else:
                self._flush()
                self._in_link = 0
                if end:
                    self._close(name)
                    continue
                if self._stack[-1][0] == "p":
                    self._pop()
                while self._stack[-1][0] in CLOSES.get(name, ()):
                    self._pop()
                self._open(name, attrs)
        self._flush()

    def _listed(self) -> set[int]:
        listed = {k for k in self._worded if self.tokens[k][1] not in WHOLE}
        for name in ("article", "main") if listed else ():
            within = self._below(listed)
            own = [k for k, t in self.tokens.items() if t[1] == name and not t[2]]
            # with one elsewhere, those within are cards or comments; so are those with a listed word of their own
            if all(within[self.tokens[k][0]] for k in own):
                holds = {k for k in own if k not in self._worded}
                for key, token in reversed(self.tokens.items()):
                    if key in holds and key != ROOT:
                        holds.add(token[0])
                listed = listed - (holds - set(own))
        return listed | self._nested

    def _below(self, keys: set[int]) -> dict[int, bool]:
        """Per element whether it or one around it is among the keys."""
        out = {ROOT: ROOT in keys}
        for key, token in self.tokens.items():
            if key != ROOT:
                out[key] = out[token[0]] or key in keys
        return out

    def own(self, spared: set[int] = frozenset()) -> list[tuple[int, bool, str]]:
        """The blocks of the page's own article, main or body."""
        enough = CONTENT_SHARE * self.tokens[ROOT][4]
        cut = self._below({k for k in self.listed - spared if self.tokens[k][4] < enough})
        own = [b for b in self.blocks if not b[1] and not cut[b[0]]]
        for name in ("article", "main"):
            inside = self._below({k for k, v in self.tokens.items() if v[1] == name and not v[2]})
            kept = [b for b in own if inside[b[0]]]
            if kept:
                return kept
        return own

    def article_bit(self) -> int:
        """One of 64 bits, by the text of the page's own article."""
        return 1 << xxhash.xxh64_intdigest(" ".join(t for _, _, t in self.own()).encode()) % 64

    def _slot_blocks(self, roots: set[int], cut: set[int]) -> list[tuple[int, bool, str]]:
        """The blocks within the slots and not below a cut element in them."""
        state = {ROOT: (ROOT in roots, False)}
        for key, token in self.tokens.items():
            if key != ROOT:
                slot, gone = state[token[0]]
                state[key] = (True, gone or key in cut) if slot else (key in roots, False)
        return [b for b in self.blocks if not b[1] and state[b[0]] == (True, False)]

    def text(self, roots: list[set[int]], menus: set[int], constant: set[int], spared: set[int] = frozenset()) -> str:
        """The text of the first kind of content slots that has any; else of the page's own article, main or body."""
        cut = self.listed - spared
        kept = next((b for b in (self._slot_blocks(r, cut) for r in roots if r) if b), None) or self.own(spared)
        menu = self._below(menus)
        return " ".join(t for k, _, t in kept if not menu[k] and (not constant or text_key(k, t) not in constant))


def text_key(path: int, text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode(), (path ^ 0x5BD1E995) & 0xFFFFFFFFFFFFFFFF))


_TOKEN_FIELDS = [("host", pa.string()), ("key", pa.int64()), ("parent", pa.int64()), ("name", pa.string()),
                 ("outside", pa.bool_()), ("listed", pa.bool_()), ("support", pa.int64()), ("chars", pa.int64()), ("links", pa.int64()),
                 ("vec", pa.int64()), ("vec_sum", pa.int64()), ("articles", pa.int64())]
_TOKEN_SCHEMA = ("host string, key long, parent long, name string, outside boolean, listed boolean, support long, "
                 "chars long, links long, vec long, vec_sum long, articles long")


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute url, else the empty string."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def token_vectors(pages: DataFrame) -> DataFrame:
    """One row per host and token: its support and the hash of its occurrence vector.

    A text token has the name ``#text`` and the element around it as parent.
    ``articles`` has a bit for each article text of the token's pages (64 bits, so
    some share one: never more bits than texts).
    """
    def run(batches):
        for b in text_blocks(batches, "html", 2 << 20):
            found: dict[tuple, list] = {}
            for i, (host, source) in enumerate(zip(b.column("host").to_pylist(), utf8_list(b.column("html")))):
                page = Page(source.decode())
                page_key = b.column("page")[i].as_py() & 0xFFFFFFFFFFFFFFFF
                article = page.article_bit()
                counts = [(k, p, n, o, k in page.listed, c, ch, li)
                          for k, (p, n, o, c, ch, li) in page.tokens.items()]
                texts: dict[tuple[int, int, bool], int] = defaultdict(int)
                for key, outside, text in page.blocks:
                    if not outside:
                        texts[text_key(key, text), key, outside] += 1
                counts += [(k, p, "#text", o, False, c, 0, 0) for (k, p, o), c in texts.items()]
                for k, p, n, o, listed, c, ch, li in counts:
                    h = xxhash.xxh64_intdigest(c.to_bytes(8, "little"), page_key)
                    row = found.setdefault((host, k), [p, n, o, True, 0, 0, 0, 0, 0, 0])
                    row[3] &= listed
                    row[4] += 1
                    row[5] += ch
                    row[6] += li
                    row[7] ^= h
                    row[8] += h >> 34
                    row[9] |= article
            rows = [(h, k, *v[:7], _signed(v[7]), v[8], _signed(v[9])) for (h, k), v in found.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_TOKEN_FIELDS)],
                [n for n, _ in _TOKEN_FIELDS])

    bounded_batches(pages.sparkSession)
    parts = pages.mapInArrow(run, _TOKEN_SCHEMA)
    return parts.groupBy("host", "key").agg(
        F.min("parent").alias("parent"), F.min("name").alias("name"), F.bool_or("outside").alias("outside"),
        F.bool_and("listed").alias("listed"),
        F.sum("support").alias("support"), F.sum("chars").alias("chars"), F.sum("links").alias("links"),
        F.bit_xor("vec").alias("vec"), F.sum("vec_sum").alias("vec_sum"), F.bit_or("articles").alias("articles"))


def templates(tokens: DataFrame) -> DataFrame:
    """Per host with a template: the keys of content slots, menu slots, constant texts, and of elements that
    the word list would take out but for their share of the text."""
    size = tokens.where(F.col("key") == ROOT).select("host", F.col("support").alias("pages"),
                                                     F.col("chars").alias("all_chars"))
    # a fixed bound first: the texts that are a page's own never reach the join
    repeated = tokens.where(F.col("support") >= F.when(F.col("name") == "#text", TEXT_PAGES).otherwise(MIN_PAGES))
    frequent = repeated.join(size, "host").where(
        F.col("support") >= F.least(F.col("pages") * SUPPORT, F.lit(float(ENOUGH_PAGES))))
    classes = frequent.groupBy("host", "support", "vec", "vec_sum").agg(F.count("*").alias("members"))
    large = written(frequent.join(classes.where(F.col("members") >= CLASS_SIZE),
                                  ["host", "support", "vec", "vec_sum"]), "template-tokens")
    # valid: below the root through tokens of large classes; one level per round
    enough = F.col("chars") >= CONTENT_SHARE * F.col("all_chars")
    valid = written(large.where(F.col("key") == ROOT).select("host", "key", F.lit(False).alias("cut")), "template-valid")
    done = level = valid
    while level.take(1):
        below = large.where((F.col("name") != "#text") & (F.col("key") != ROOT)).join(
            level.select("host", F.col("key").alias("parent"), "cut"), ["host", "parent"])
        cut = F.col("cut") | (F.col("listed") & ~enough)
        level = written(below.select("host", "key", cut.alias("cut")), "template-valid")
        done = done.union(level)
    elements = large.join(done, ["host", "key"])
    inside = elements.where(~F.col("outside") & ~F.col("cut") & (F.col("key") != ROOT))
    per_host = Window.partitionBy("host")
    ranked = inside.withColumn("kind", F.when(F.col("name") == "article", 1).when(F.col("name") == "main", 2)
                               .when(enough & ~F.col("name").isin("html", "body"), 3))
    least = F.min(F.when(F.col("kind") == 3, F.col("chars"))).over(per_host)
    ranked = ranked.withColumn("least", least)

    def slot(kind: int) -> Column:
        own = (F.col("kind") == kind) & ((F.lit(kind) < 3) | (F.col("chars") == F.col("least")))
        return F.collect_list(F.when(own, F.col("key")))
    menu = ((F.col("links") >= LINK_SHARE * F.col("chars")) & (F.col("chars") > 0)
            & (F.col("support") >= 0.5 * F.col("pages")) & F.col("kind").isNull()
            & ~F.col("name").isin("html", "body"))
    slots = ranked.groupBy("host").agg(
        F.array(slot(1), slot(2), slot(3)).alias("roots"),
        F.collect_list(F.when(menu, F.col("key"))).alias("menus"),
        F.collect_list(F.when(F.col("listed") & enough, F.col("key"))).alias("spared"))
    around = elements.select("host", F.col("key").alias("parent"), F.col("vec").alias("p_vec"),
                             F.col("vec_sum").alias("p_sum"))
    fixed = (large.where((F.col("name") == "#text") & (F.bit_count("articles") >= TEXT_ARTICLES))
             .join(around, ["host", "parent"]).where("vec = p_vec AND vec_sum = p_sum")
             .groupBy("host").agg(F.collect_list("key").alias("constant")))
    return slots.join(fixed, "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of ``pages`` (page_id, url, html)."""
    src = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    # copies of a page are one page of the template, or its own text would pass as constant
    each = src.select("host", "html", F.xxhash64("html").alias("page"))
    copied = written(each.groupBy("host", "page").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "template-copies")
    # pages that occur once are not shuffled
    distinct = each.join(copied, ["host", "page"], "left_anti").unionByName(
        each.join(copied, ["host", "page"], "left_semi").distinct())
    vectors = token_vectors(distinct)
    template = written(templates(written(vectors, "template-vectors")), "templates")
    rows = src.join(template, "host", "left").select("page_id", "url", "html", "roots", "menus", "constant", "spared")

    def run(batches):
        for b in text_blocks(batches, "html"):
            slots = zip(*(b.column(c).to_pylist() for c in ("roots", "menus", "constant", "spared")))
            out = [Page(source.decode()).text([set(r) for r in roots or ()], *(set(x or ()) for x in keys))
                   for source, (roots, *keys) in zip(utf8_list(b.column("html")), slots)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())],
                                             ["page_id", "url", "text"])
    return rows.mapInArrow(run, src.select("page_id", "url").schema.add("text", "string"))
