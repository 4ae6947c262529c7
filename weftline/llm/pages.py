"""Main text of web pages by consensus host paths: pages vote for their best container, hosts decide."""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, schema_of

#: Elements whose content is no markup. A page may end inside the first two; the others need their end tag.
RAW = ("script", "style", "textarea", "title", "iframe")
#: Elements inside a line whose content is no text of the page.
SKIPPED = frozenset("noscript template svg select button object canvas audio video".split())
BOXES = frozenset("body div article section main nav header footer aside form ul ol dl table blockquote figure center details fieldset menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math q ruby s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset("mi mn mo mrow ms mspace msqrt mroot mfrac msub msup msubsup mtext munder mover munderover mtable mtr mtd mstyle semantics annotation merror mpadded mphantom".split())
#: Elements and roles whose content is no article.
OFF_TAGS = frozenset("nav footer aside form menu dialog".split())
OFF_ROLES = frozenset("navigation complementary contentinfo search dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id that say what is no article: those that say so beside any other words,
UNIQUE = frozenset("navbar breadcrumb breadcrumbs sidebar footer gdpr disqus commentlist newsletter pagination advertisement advertisements sponsored".split())
#: those that do beside words of layout,
STRONG = frozenset("ad ads advert adverts promo promotions nav menu cookie banner popup modal overlay subscribe signup share sharing comment comments replies recommended recommendations widget login pager toolbar".split())
#: and those that are as well names of an article's parts, which they are where a heading and sentences follow.
WEAK = frozenset("advertising sponsor promotion navigation cookies consent notice notices alert subscription social reply respond discussion related search skip".split())
OFF_WORDS = UNIQUE | STRONG | WEAK
#: Words of layout. Beside others a mark is a name: related-work, social-science, ad-hoc.
HELPERS = frozenset("box bar list lists item items link links post posts article articles section container wrapper wrap area block blocks button buttons icon icons media story stories content contents inner outer body head title heading text top bottom left right main site page header group row col column columns field form input label unit slot zone space holder panel card cards module region view feed thread board forum count message messages info new more also you may like most popular recent latest trending read see tag tags author meta div ul li the my by to for us follow wrapper primary secondary global local mobile desktop sticky fixed floating inline notes".split())
#: A class that begins with one of these tells how a container is laid out, not what it holds: has-sidebar, no-comments.
ABOUT = frozenset("has have no not non with without is hide show hides shows hidden enable enabled disable disabled open opened closed single page post entry layout theme js two one left right full".split())
HEAD_WORDS = frozenset(["header", "masthead"])
#: Share of a container's good text that a child must hold to be the better container.
DEEPER = 0.6
#: Share of its host's votes that a winning path has, so a host has 1 / SHARE of them at most; a page that has none of them decides for itself.
SHARE = 0.02
#: Characters that the paths of all hosts may have to be broadcast.
BROADCAST_CHARS = 16_000_000
#: Characters of a block of sentences, and the most of it that may be links.
SENTENCES, LINKED = 80, 0.3
#: Containers inside each other; deeper ones count as part of the last.
DEPTH = 200
_CONTENT = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STEP = re.compile(r"""=\s*(["'])|>""")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


class Box:
    """A container. marked: 2 if its marks say it is no article, 1 if they may; around: these are marks that may stand around a whole page."""

    __slots__ = ("tag", "path", "marked", "around", "off", "head", "up", "kids", "good", "prose", "heads")

    def __init__(self, tag, path, marked, around, head, up):
        self.tag, self.path, self.marked, self.around, self.head, self.up, self.kids, self.good, self.prose, self.heads = tag, path, marked, around, head, up, [], 0.0, 0, 0
        self.off = False
        if up is not None:
            up.kids.append(self)


def _marks(said: str):
    """The words of each class or id, split at what is no letter and at humps; none of those that only tell the layout."""
    for token in said.split():
        words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", token)]
        if words and not (words[0] in ABOUT and len(words) > 1):
            yield words


def _told(said: str) -> int:
    """What classes or ids say: 2 no article, 1 perhaps none, 0 nothing."""
    worst = 0
    for words in _marks(said):
        off = [w for w in words if w in OFF_WORDS]
        if not off:
            continue
        if UNIQUE.intersection(off):
            return 2
        if all(w in OFF_WORDS or w in HELPERS or len(w) < 3 for w in words):
            if len(off) > 1 or off[0] in STRONG:
                return 2
            worst = 1
    return worst


def _read(attrs: str) -> dict:
    found: dict = {}
    for m in _ATTR.finditer(attrs):
        found.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    return found


def _unseen(found: dict) -> bool:
    style = found.get("style", "").replace(" ", "").lower()
    return "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


def _hides(tag: str, attrs: str) -> bool:
    """Do the attributes of an element that is no container say that it is no part of the article? A heading's id is its name, and a part of a line may be called anything but an advert or the like."""
    found = _read(attrs)
    if _unseen(found) or found.get("role", "").lower() in OFF_ROLES:
        return True
    if len(tag) == 2 and tag[0] == "h" or tag in INLINE:
        return _told(found.get("class", "")) == 2
    told = max(_told(found.get("class", "")), _told(found.get("id", "")))
    return told == 2 or told == 1 and "discussion" not in f"{found.get('class', '')} {found.get('id', '')}".lower()


def _box(tag: str, attrs: str, up: Box) -> Box:
    found = _read(attrs) if attrs else {}
    classes, name = found.get("class", ""), found.get("id", "")
    mark = "".join("." + re.sub(r"\d+", "0", c) for c in sorted(classes.lower().split())) or ("#" + re.sub(r"\d+", "0", name.lower()) if name else "")
    role = found.get("role", "").lower()
    told = max(_told(classes), _told(name)) if attrs else 0
    unseen = bool(found) and _unseen(found)
    marked = 0 if tag == "body" and not unseen else 2 if tag in OFF_TAGS or role in OFF_ROLES or unseen else told
    words = {w for said in (classes, name) for ws in _marks(said) for w in ws} if attrs else set()
    around = unseen or tag in ("form", "dialog") or role in ("dialog", "alertdialog") or bool(words & {"modal", "popup", "overlay", "widget"})
    head = up.head or tag == "header" or role == "banner" or bool(words & HEAD_WORDS)
    return Box(tag, f"{up.path}/{tag}{mark}" if up.path else tag + mark, marked, around, head, up)


def _unclosed(source: str, tag: str) -> set[int]:
    """Where those elements of this name begin that nothing closes: no end tag, or, where they do not stand in each other, another one first."""
    open_, out = [], set()
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])", source, re.I):
        if m[1]:
            if open_:
                open_.pop()
        else:
            if tag not in ("svg", "object", "template") and open_:
                out.add(open_.pop())
            open_.append(m.start())
    return out.union(open_)


def scan(source: str):
    """(start, end, tag, is it an end tag, attributes) of each piece of markup in order; tag "" for what is only dropped.

    Each character is looked at a bounded number of times: a quote opens only after "=", and once one has no partner, all later
    tags end at their next ">"; an end tag that was searched in vain is not searched again."""
    at, plain, missing, size = 0, False, set(), len(source)
    while True:
        i = source.find("<", at)
        if i < 0:
            return
        c = source[i + 1 : i + 2]
        if c in "!?" or c == "/" and not source[i + 2 : i + 3].isalpha():
            if not c or c == "/" and i + 2 >= size:
                at = i + 1
                continue
            if source.startswith("<!--", i):
                short = 5 if source.startswith("<!-->", i) else 6 if source.startswith("<!--->", i) else 0
                j = i + short if short else source.find("-->", i + 4) + 3
                at = j if j > i else size
            else:
                close = "]]>" if source.startswith("<![CDATA[", i) and "cdata" not in missing else ">"
                j = source.find(close, i)
                if j < 0 and close == "]]>":
                    missing.add("cdata")
                    j, close = source.find(">", i), ">"
                at = j + len(close) if j >= 0 else size
            yield i, at, "", False, ""
            continue
        end = c == "/"
        m = _NAME.match(source, i + 1 + end)
        if not m or not m[0][0].isascii():
            at = i + 1
            continue
        j = source.find(">", m.end())
        if j < 0:
            if "<" not in source[i + 1 :]:
                yield i, size, "", False, ""  # the page ends inside a tag
            return
        if not plain and ('"' in (part := source[m.end() : j]) or "'" in part):
            p = m.end()
            while step := _STEP.search(source, p):
                if step[0] == ">":
                    j = step.start()
                    break
                p = source.find(step[1], step.end()) + 1
                if not p:
                    break
            else:
                p = 0
            plain = not p
        at, tag = j + 1, m[0].lower()
        yield i, at, tag, end, source[m.end() : j]
        if tag in _CONTENT and not end and tag not in missing:
            close = _CONTENT[tag].search(source, at)
            if close or tag in RAW[:2]:
                if (to := close.start() if close else size) > at:
                    yield at, to, "", False, ""
                at = to
            else:
                missing.add(tag)


def read_page(source: str) -> tuple[Box, list[tuple[Box, str, float, bool]]]:
    """(root, blocks): a block is its container, its text, the share of it in links, and if it is a heading. A forgiving
    scan: raw elements and comments go, unknown end tags are passed over, an end tag closes what is open inside it. What stands in
    SKIPPED elements goes too, however long; of those that are never closed their tags alone do. An element that is no container but marked as no
    article is a container of its own, up to its end tag or the next block of its kind; inside a line, what it holds is passed over."""
    root = box = Box("", "", 0, False, False, None)
    blocks, text, linked, depth, heading, in_head = [], [], 0, 0, False, False
    at, inside, nested = 0, "", 0
    mute, muted = "", 0
    unclosed: dict = {}
    level, flat, odd = 0, Counter(), []

    def close():
        nonlocal text, linked
        whole = " ".join(html.unescape("".join(text)).split())
        if whole:
            blocks.append((box, whole, min(1.0, linked / len(whole)), heading))
        text, linked = [], 0

    def add(piece):
        nonlocal linked
        if not inside and not in_head and not muted:
            text.append(piece)
            if depth:
                linked += len(piece.strip())

    def leave(to):
        """Goes up to a container that is open."""
        nonlocal box, level
        while box is not to:
            if odd and odd[-1] is box:
                odd.pop()
            box, level = box.up, level - 1

    for start, end_at, tag, end, attrs in scan(source):
        if start > at:
            add(source[at:start])
        at = end_at
        if not tag:
            continue
        if tag in SKIPPED:
            if inside == tag:
                nested += -1 if end else 1
                inside = inside if nested else ""
            elif not inside and not end and not attrs.endswith("/"):
                if tag not in unclosed:
                    unclosed[tag] = _unclosed(source, tag)
                if start not in unclosed[tag]:
                    inside, nested = tag, 1
            continue
        if inside:
            continue
        if tag == "a":
            depth = max(0, depth - 1) if end else depth + 1
        if tag in INLINE:
            if muted and tag == mute:
                muted += -1 if end else 1
            elif not muted and not end and attrs and _hides(tag, attrs):
                mute, muted = tag, 1
            continue
        close()
        muted = 0  # what is never closed in a line ends with it
        block = tag in BOXES or "-" in tag
        if odd and odd[-1] is box and (tag == box.tag or not end and (box.tag == "p" or len(box.tag) == 2 and box.tag[0] == "h" and box.tag != "hr") or {tag, box.tag} <= {"td", "th", "tr"} or {tag, box.tag} <= {"dt", "dd"}):
            leave(box.up)
        if tag == "head":
            in_head = not end
        elif tag == "body" and not end:
            in_head = False
        if not block and not end and attrs and level < DEPTH and _hides(tag, attrs):
            box, level = Box(tag, f"{box.path}/{tag}", 2, False, box.head, box), level + 1
            odd.append(box)
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            heading = not end
            if heading:
                box.heads += 1
        elif block:
            heading = False
            if not end:
                if attrs.endswith("/") and tag not in BOXES:
                    continue
                if level < DEPTH:
                    box, level = _box(tag, attrs, box), level + 1
                else:
                    flat[tag] += 1
            elif flat[tag]:
                flat[tag] -= 1
            else:
                b = box
                while b is not None and b.tag != tag:
                    b = b.up
                if b is not None and b.up is not None:
                    leave(b.up)
    if at < len(source):
        add(source[at:])
    close()
    return root, blocks


def _every(root: Box) -> list:
    out, stack = [], [root]
    while stack:
        b = stack.pop()
        out.append(b)
        stack += reversed(b.kids)
    return out


def _good(boxes: list, blocks: list) -> None:
    """Sums up each container's good text: what links and boilerplate leave, a short block counting less; and its sentences: long blocks that are no links."""
    for b in boxes:
        b.good, b.prose, b.off = 0.0, 0, b.marked == 2 or b.up is not None and b.up.off
    for box, text, linked, heading in blocks:
        if not box.off:
            good = len(text) * (1 - linked) * min(1.0, len(text) / 40)
            prose = len(text) if len(text) >= SENTENCES and linked < LINKED and not heading and not box.head else 0
            b = box
            while b is not None:
                b.good, b.prose, b = b.good + good, b.prose + prose, b.up


def settle(root: Box, blocks: list) -> None:
    """Decides which marks count. A name that an article's part may have is no mark where the container has a heading and sentences of its own. Where nothing
    but what is marked has sentences, or a heading outside headers, marks that may stand around a whole page (a form, a dialog) are taken back from those that have."""
    boxes = _every(root)
    weak = [b for b in boxes if b.marked == 1]
    for b in weak:
        b.marked = 0
    heads = {id(b): b.heads for b in boxes}
    for b in reversed(boxes[1:]):  # children stand behind their parents
        heads[id(b.up)] += heads[id(b)]
    _good(boxes, blocks)
    for b in weak:
        if not (heads[id(b)] and b.prose):
            b.marked = 2
    if weak:
        _good(boxes, blocks)
    while not root.prose and not any(heading and not box.off and not box.head for box, _, _, heading in blocks):
        outer = [b for b in boxes if b.marked == 2 and b.around and not (b.up is not None and b.up.off) and (heads[id(b)] or any(k.tag in ("article", "main") for k in _every(b)))]
        if not outer:
            return
        for b in outer:
            b.marked = 0
        _good(boxes, blocks)


def judge(root: Box, blocks: list) -> tuple[str, float]:
    """(path of the best container, its share of the page's good text). From the top, an article or main element is entered, else the child that
    holds all sentences; where there are none, the child with most good text, for as long as one has most of it."""
    settle(root, blocks)
    total = root.good
    if not total:
        return "", 0.0
    best = root
    while True:
        named = [k for k in best.kids if k.tag in ("article", "main") and k.good > 0.2 * best.good]
        kid = max(named or best.kids, key=lambda k: (k.prose, k.good), default=None)
        if kid is None or not named and (kid.prose < best.prose or not best.prose and kid.good < DEEPER * best.good):
            return best.path, best.good / total
        best = kid
        if kid.tag == "article":
            return best.path, best.good / total


def _within(path: str, outer: str) -> bool:
    return path == outer or not outer or path.startswith(outer + "/")


def _common(a: str, b: str) -> str:
    """The path that both begin with."""
    out = []
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        out.append(x)
    return "/".join(out)


def main_text(source: str | None, paths: list[str] | None) -> tuple[str, str]:
    """(text, path) by the first of `paths` that holds good text here, or by the page's own best container, if that holds it or no path does. Where the two are
    parts of one article or main element, that is read, so nothing of the article is left out; so is the page's own container if it holds the path's and is not the whole body."""
    if not source:
        return "", ""
    root, blocks = read_page(source)
    own, _ = judge(root, blocks)

    def under(path):
        out = []
        for box, text, _, heading in blocks:
            b, inside = box, not path
            while b is not None and not inside:
                inside, b = b.path == path, b.up
            if inside and not box.off and (not box.head or heading and path):
                out.append(text)
        return out

    # Good text by path, and whether it stands in an article or main element.
    boxes: dict = {}
    for b in _every(root):
        boxes[b.path] = boxes.get(b.path, 0) + b.good
    for path in paths or []:
        if boxes.get(path, 0) <= 0:
            continue
        if _within(own, path):
            return " ".join(under(path)), path
        shared = own if _within(path, own) else _common(own, path)
        if any(step.split(".")[0].split("#")[0] in ("article", "main") for step in shared.split("/")) or shared == own and "/" in own:
            return " ".join(under(shared)), shared  # the article goes on beside the host's container
        return " ".join(under(path)), path
    return " ".join(under(own)), own


def _votes(batches):
    for batch in batches:
        out = []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            path, share = judge(*read_page(source)) if source else ("", 0.0)
            out.append((host, path, share))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["host", "path", "share"])


def _texts(batches):
    for batch in batches:
        names = batch.schema.names
        got = [main_text(s, p) for s, p in zip(batch.column(names.index("__html")).to_pylist(), batch.column(names.index("__paths")).to_pylist())]
        own = [k for k, n in enumerate(names) if n not in ("__html", "__paths")]
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in own], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], [*[names[k] for k in own], "text", "path"])


def host_of(url):
    return F.nullif(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def winners(pages: DataFrame) -> DataFrame:
    """host, paths: the host's paths by votes. A page's vote is the share of its good text that its best container holds;
    sums combine before the shuffle, so a host with most pages is no hot key."""
    votes = pages.filter("html is not null and html <> ''").select(host_of(F.col("url")).alias("host"), "html").filter("host is not null").mapInArrow(_votes, "host string, path string, share double")
    summed = votes.filter("path <> ''").groupBy("host", "path").agg(F.round(F.sum("share"), 6).alias("votes"))
    of_host = summed.groupBy(F.col("host").alias("of")).agg(F.sum("votes").alias("all"))
    kept = summed.join(of_host, F.col("host") == F.col("of")).filter(F.col("votes") >= SHARE * F.col("all"))
    return kept.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("less"), "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path for each row of pages (page_id, url, html).

    Pages score their containers and vote; a page is then read by the first of its host's winning paths (those with SHARE of its votes) that holds good text
    here, unless its article goes on outside of that. Blocks of the container keep page order, without
    boilerplate parts; character references are decoded and white space is one space.

    Null or empty html: empty text. Null url or one without a host: the page decides alone. Repeated rows: each is read
    (and votes). Ties of votes: the smaller path. Very long pages are read whole, one at a time. Empty table: no rows.
    Other columns don't matter. Pages do not move while the hosts' paths fit a checked broadcast.
    """
    rows = pages.select("page_id", "url", "html")
    wins = saved(winners(rows), "paths").withColumnRenamed("host", "__host")
    chars = wins.agg(F.sum(F.length("__host") + F.length(F.array_join("paths", "")))).first()[0] or 0
    wins = F.broadcast(wins) if chars <= BROADCAST_CHARS else wins
    joined = rows.withColumn("__h", host_of(F.col("url"))).join(wins, F.col("__h") == F.col("__host"), "left").select("page_id", "url", F.col("html").alias("__html"), F.col("paths").alias("__paths"))
    out = joined.mapInArrow(_texts, schema_of(rows.select("page_id", "url")) + ", text string, path string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")
