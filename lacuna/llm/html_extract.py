"""Main-text extraction with site-template removal.

Each page is parsed into block elements. Every element's subtree (tag, class,
id, text and children) is hashed, Spark counts in how many different pages of
a host each subtree occurs, and subtrees that recur are deleted as template: on
half of the host's pages anywhere, on fewer (``LOW_SHARE``, ``MIN_PAGES`` at least)
if they keep their place, counted from the start or the end of the page or article.
Elements that say what they are (navigation, header,
footer, sidebar, notice, advert, form, script, style, comments: by tag, role,
class or id) go as well, and where a page marks its article, text outside it.
An article inside such an element is a teaser and marks nothing; nor does one without
kept text. What a class, id, role, form or hidden mark names stays if it holds most of
the page's text.
Copies of one text count once, so that a much-copied article is no template, and a
much-copied paragraph changes its place. Headings have a place of their own and need
half of the pages. Near copies keep their paragraphs: a page does not lose its last
paragraph, nor three or more that make up most of its text.

Null or empty html gives the empty text. A null or host-less url has no
template. Truncated pages, unclosed tags and stray markup are tolerated.
Repeated rows are extracted each. Parsing is linear in the page.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.textops import map_arrow
from lacuna.session import materialize

MIN_PAGES = 10
MIN_SHARE = 0.5
LOW_SHARE = 0.005  # so a host has at most 1 / LOW_SHARE times as many templates as a page has elements
FIXED_SHARE = 0.8
COPIED = 3
SALTS = 8
OUTSIDE, NAMED, MARKED = 0, 1, 2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[A-Za-z]+")

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes".split())  # unclosed: to the end of the page
SKIPPED = frozenset("template svg math canvas object select button".split())  # unclosed: the tag alone
DROPPED = frozenset("head nav header footer aside form dialog menu".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption caption summary".split())
_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I) for tag in RAW | SKIPPED}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
LABELS = HEADINGS | frozenset("li td th dt caption figcaption summary".split())
CLOSES_P = BLOCKS - {"head", "html", "body"}
DROPPED_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead topbar header footer sidebar aside widget notice notices alert cookie cookies consent gdpr "
    "banner ad ads advert adverts advertisement advertising sponsor sponsored promo popup modal overlay newsletter subscribe signup login share sharing social "
    "related recommended pagination pager toolbar copyright hidden comment comments replies disqus respond search".split()
)
COMMENT_NAMES = frozenset("comment comments replies disqus respond".split())
# a whole class or id token is compared; of a compound one only these first parts, or a name after one of these qualifiers
DROPPED_PREFIXES = ("ad-", "ads-", "advert-", "nav-", "navbar-", "menu-", "cookie-", "cookies-", "consent-", "gdpr-", "breadcrumb-", "newsletter-", "share-", "sharing-",
                    "social-", "sponsored-", "promo-", "popup-", "modal-", "banner-", "pagination-", "footer-", "masthead-", "related-")
COMMENT_TOKENS = COMMENT_NAMES | frozenset("comments-area comments-section comments-list comments-wrapper comments-wrap comments-container disqus-thread disqus_thread".split())
TITLE_TOKENS = frozenset("post-header article-header blog-header".split())
QUALIFIERS = frozenset("site page main top bottom global primary secondary left right mobile post article blog sub user".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
            "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",))}


def _named(tokens: list[str]) -> str | None:
    """'comment' or 'soft' if one of the class or id tokens names an element that is no content."""
    found = None
    for token in tokens:
        head, _, tail = token.replace("_", "-").partition("-")
        plain = f"{head}-{tail}" if tail else head
        if plain in COMMENT_TOKENS or plain.startswith("comment-") or head in QUALIFIERS and tail in COMMENT_NAMES:
            return "comment"
        if plain in DROPPED_NAMES or plain.startswith(DROPPED_PREFIXES) or head in QUALIFIERS and tail in DROPPED_NAMES and plain not in TITLE_TOKENS:
            found = "soft"
    return found


class _Element:
    __slots__ = ("tag", "parent", "drop", "article", "named", "names", "parts", "digest", "text", "titled", "mass", "lead", "index", "size",
                 "in_article", "header", "headed", "state", "label", "paths")

    def __init__(self, tag, parent, drop, article, names):
        self.tag, self.parent, self.drop, self.article, self.names = tag, parent, drop, article, names
        self.parts, self.digest, self.text, self.titled = [], 0, False, False
        # an article with a name to drop; characters of text, without what tags drop; holds a first heading or <main>
        self.named, self.mass, self.lead = False, 0, False
        self.index, self.size = 0, 0  # place among what has text in the parent; how much of that it has itself
        # on the way up, itself included: an article comes before a header; the nearest header; a heading has come up through it
        self.in_article = tag != "header" and (article or parent is not None and parent.in_article)
        self.header = self if tag == "header" else parent.header if parent is not None else None
        self.headed = False
        # handed down once the page is read: (dropped, place, inner, spare, recurring), whether a label holds it, hashes of its place
        self.state, self.label, self.paths = None, False, (0, 0)


def _describe(tag: str, attrs: str) -> tuple[str, str | None]:
    """(class and id names for the hash, reason to drop: 'soft' yields if it holds most of the page's text, 'comment' if also the title or main, 'hard' does not)."""
    names, drop = "", "soft" if tag == "form" else "hard" if tag in DROPPED else None
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                names += " " + " ".join(sorted({w.lower() for w in _NAME.findall(value)}))
                named = _named(value.lower().split())
                if drop != "hard" and named:
                    drop = "comment" if "comment" in (named, drop) else "soft"
            elif key == "role":
                drop = drop or ("soft" if value.lower() in DROPPED_ROLES else None)
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                drop = drop or "soft"
    return names, drop


class Page:
    """Blocks of one page: (text, element) in page order, elements with subtree digests."""

    def __init__(self, source: str):
        self.elements: list[_Element] = []
        self.blocks: list[tuple[str, _Element]] = []
        self.stack = [_Element("", None, None, False, "")]
        self.buffer: list[str] = []
        self.open: dict[str, list[int]] = {}  # places on the stack of the open elements, by tag
        self.open_blocks: list[int] = []
        endless = set()  # tags of which no end follows
        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            if not m:
                self.buffer.append(html.unescape(source[at:]))
                break
            if m.start() > at:
                self.buffer.append(html.unescape(source[at : m.start()]))
            at = m.end()
            closing, tag = m[1] if m[2] else m[4], (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if closing:
                self._end(tag)
            elif tag in RAW or tag in SKIPPED:
                end = None if tag in endless else _END[tag].search(source, at)
                if end is None:
                    endless.add(tag)
                at = end.end() if end else n if tag in RAW else at
                self.buffer.append(" ")
            else:
                self._start(tag, m[3] or "")
        while len(self.stack) > 1:
            self._pop()
        self._flush()
        self._hand_down()

    def _push(self, e: _Element) -> None:
        self.open.setdefault(e.tag, []).append(len(self.stack))
        if e.tag in BLOCKS:
            self.open_blocks.append(len(self.stack))
        self.stack.append(e)
        self.elements.append(e)

    def _last(self, tags) -> int:
        """The highest place on the stack of an element with one of the tags; 0 if none is open."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def _flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            self.buffer = []
            if text:
                top = self.stack[-1]
                self.blocks.append((text, top))
                top.parts.append(text)
                top.text = True
                top.size += 1
                top.mass += len(text)

    def _pop(self) -> None:
        self._flush()
        e = self.stack.pop()
        self.open[e.tag].pop()
        if e.tag in BLOCKS:
            self.open_blocks.pop()
        e.digest = xxhash.xxh3_64_intdigest("\x1f".join([e.tag, e.names, *e.parts])) - (1 << 63)
        self.stack[-1].parts.append(f"\x1e{e.digest}")
        self.stack[-1].text |= e.text
        e.index = self.stack[-1].size
        self.stack[-1].size += e.text
        if e.drop != "hard" or e.titled:
            self.stack[-1].mass += e.mass

    def _start(self, tag: str, attrs: str) -> None:
        if tag in ("br", "wbr", "img", "input"):
            self.buffer.append(" " if tag != "wbr" else "")
            return
        names, drop = _describe(tag, attrs)
        if tag not in BLOCKS:
            # an inline element that names itself an advert and the like, and those of its kind inside it
            if tag not in VOID and (drop or self.open.get(tag)):
                self._flush()
                self._push(_Element(tag, self.stack[-1], drop, False, names))
            return
        self._flush()
        if tag in ("html", "body"):
            return
        if tag in CLOSES_P and self.open_blocks and self.stack[self.open_blocks[-1]].tag == "p":
            self._pop_to(self.open_blocks[-1])
        if tag in SIBLINGS:
            self._close(*SIBLINGS[tag])
        if tag in VOID:
            return
        up = self.stack[-1]
        article = tag in ("article", "main") and drop not in ("hard", "comment") or "role" in attrs and re.search(r"role\s*=\s*[\"']?main", attrs, re.I) is not None
        named = article and drop == "soft"
        e = _Element(tag, up, None if named else drop, article, names)
        e.named = named
        if tag in ("h1", "h2"):
            self._title(up)
        if tag in ("h1", "main"):
            self._lead(e)
        self._push(e)

    def _title(self, e: _Element) -> None:
        """A header that holds a heading inside an article belongs to the article."""
        header = e.header
        while header is not None and not header.headed:
            header.headed = True
            header.titled = header.article or header.parent.in_article
            header = header.parent.header

    def _lead(self, e: _Element) -> None:
        while e is not None and not e.lead:
            e.lead, e = True, e.parent

    def _pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            self._pop()

    def _close(self, tags, stop) -> None:
        tags = (tags,) if isinstance(tags, str) else tags
        place = self._last(tags)
        if place > self._last(stop):
            self._pop_to(place)

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if self.open.get(tag):
            self._pop_to(self.open[tag][-1])

    def _hand_down(self) -> None:
        """Labels and places of all elements, from each parent to its children."""
        for e in self.elements:  # parents come first
            up = e.parent
            e.label = not e.article and (e.tag in LABELS or up.label)
            if e.article:
                e.paths = _key(f"{e.tag}<"), _key(f"{e.tag}>")
            else:
                first, last = up.paths
                e.paths = _key(f"{e.tag}{e.index}<{first}"), _key(f"{e.tag}{up.size - e.index}>{last}")

    def _judge(self, sure=frozenset(), likely=frozenset()) -> None:
        """The state of all elements, from each parent to its children."""
        self.stack[0].state = (False, OUTSIDE, False, False, False)
        half = self.stack[0].mass
        for e in self.elements:
            dropped, place, inner, spare, recurring = e.parent.state
            if not dropped:
                dropped = self._dropped(e)
                if e.article:
                    place = max(place, NAMED if e.named and 2 * e.mass <= half else MARKED)
                else:
                    if e.digest in sure:
                        inner |= e.tag in PROSE
                        recurring |= e.tag not in PROSE
                    spare |= e.digest in likely
            e.state = (dropped, place, inner, spare, recurring)

    # ------------------------------------------------------------------ text
    def text(self, sure: frozenset | set = frozenset(), likely: frozenset | set = frozenset()) -> str:
        """Main text: marked articles if there are any with text, else the page; without what says it is no content and without templates."""
        self._judge(sure, likely)
        placed = [(t, e, found) for t, e in self.blocks if (found := self._place(e)) is not None]
        gone = [(t, e) for t, e, (_, spare) in placed if spare and not e.label]
        if gone:
            rest = [(t, e) for t, e, (_, spare) in placed if not spare and not e.label]
            if not rest or len(gone) >= COPIED and sum(len(t) for t, _ in gone) > sum(len(t) for t, _ in rest):
                placed = [(t, e, (place, False)) for t, e, (place, _) in placed]
        kept = [(t, place) for t, _, (place, spare) in placed if not spare]
        marked = any(place == MARKED for _, place in kept)
        return "\n".join(t for t, place in kept if place or not marked)

    def subtrees(self) -> dict[int, tuple[int, int]]:
        """{digest: (place from the start, place from the end)} of every element with text that is not dropped."""
        found, seen = {}, set()
        self._judge()
        for _, e in self.blocks:
            if self._place(e) is None:
                continue
            while e.parent is not None and id(e) not in seen:
                seen.add(id(e))
                found.setdefault(e.digest, e.paths)
                e = e.parent
        return found

    def _dropped(self, e: _Element) -> bool:
        """Whether the element itself says that it is no content; what holds most of the page's text is no aside."""
        if e.drop == "hard":
            return not e.titled
        return e.drop is not None and (2 * e.mass <= self.stack[0].mass or e.drop == "comment" and not e.lead)

    def _place(self, e: _Element) -> tuple[int, bool] | None:
        """None: dropped; else OUTSIDE of articles, in a NAMED one (by its name an aside, which marks nothing) or in a MARKED one,
        and whether it is template that a near copy may keep."""
        dropped, place, inner, spare, recurring = e.state
        if dropped or recurring or inner and not place:
            return None
        return place, spare or inner


def host_of(url: str | None) -> str:
    m = re.match(r".*?://([^/?#]*)", url or "", re.S)
    return m[1].lower() if m else ""


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def subtree_counts(pages: DataFrame) -> DataFrame:
    """(host_key, digest, heading, n_pages, n_place): in how many different texts of a host each subtree occurs, if in MIN_PAGES
    at least, and in how many of them at its most frequent place."""

    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host = host_of(url)
                if not host or not source:
                    continue
                page = Page(source)
                found = page.subtrees()
                heads = {e.digest for e in page.elements if e.tag in HEADINGS}
                n = len(found) + 1  # 0 stands for the page itself
                rows = ([_key(host)] * n, [0, *found], [_key(page.text())] * n, [False, *(d in heads for d in found)],
                        [0, *(f for f, _ in found.values())], [0, *(l for _, l in found.values())])
                for col, values in zip(cols, rows):
                    col += values
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["host_key", "digest", "sign", "heading", "first", "last"])

    schema = "host_key long, digest long, sign long, heading boolean, first long, last long"
    one = map_arrow(pages.select("url", "html"), run, schema).groupBy("host_key", "digest", "sign").agg(F.max("heading").alias("heading"), F.min("first").alias("first"), F.min("last").alias("last"))
    one = materialize(one, "subtree-texts")

    def most(side: str) -> DataFrame:
        per = one.groupBy("host_key", "digest", side).agg(F.count(F.lit(1)).alias("n"), F.max("heading").alias("heading"))
        return (per.groupBy("host_key", "digest").agg(F.sum("n").alias("n_pages"), F.max("n").alias(f"n_{side}"), F.max("heading").alias("heading"))
                .where(F.col("n_pages") >= MIN_PAGES))

    both = most("first").join(most("last").select("host_key", "digest", "n_last"), ["host_key", "digest"])
    return both.select("host_key", "digest", "heading", "n_pages", F.greatest("n_first", "n_last").alias("n_place"))


def templates(pages: DataFrame) -> DataFrame:
    """(host_key, sure, likely): the recurring subtrees of each host, on MIN_SHARE of its texts, or on fewer at a fixed place."""
    counts = materialize(subtree_counts(pages), "subtrees")
    sizes = counts.where(F.col("digest") == 0).select("host_key", F.col("n_pages").alias("host_pages"))
    sure = F.col("n_pages") >= F.col("host_pages") * MIN_SHARE
    fixed = (F.col("n_pages") >= F.col("host_pages") * LOW_SHARE) & (F.col("n_place") >= F.col("n_pages") * FIXED_SHARE) & ~F.col("heading")
    return (
        counts.where(F.col("digest") != 0).join(sizes, "host_key").where(sure | fixed)
        .groupBy("host_key").agg(F.collect_list(F.when(sure, F.col("digest"))).alias("sure"), F.collect_list(F.when(~sure, F.col("digest"))).alias("likely"))
    )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""
    # written first: the optimizer then knows its size and broadcasts it only below the session's threshold,
    # else both sides are dealt by host and salt, so that one host's pages spread over several tasks
    found = materialize(templates(pages), "templates").withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    keyed = map_arrow(pages.select(F.col("page_id").cast("long"), "url", "html"), _with_key, "page_id long, url string, html string, host_key long")
    dealt = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(found, ["host_key", "salt"], "left").select("page_id", "url", "html", "host_key", "sure", "likely")
    return map_arrow(joined, _texts, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def _with_key(batches):
    for batch in batches:
        keys = [_key(h) if (h := host_of(u)) else 0 for u in batch.column(1).to_pylist()]
        yield pa.record_batch([*batch.columns, pa.array(keys, pa.int64())], names=["page_id", "url", "html", "host_key"])


def _texts(batches):
    known: dict[int, tuple[frozenset, frozenset]] = {}  # the templates of the last hosts met
    for batch in batches:
        texts = []
        for i, (source, host) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            if host not in known:
                if len(known) >= 64:
                    known.clear()
                known[host] = tuple(frozenset(batch.column(c)[i].as_py() or ()) for c in (4, 5))
            texts.append(Page(source).text(*known[host]) if source else "")
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])
