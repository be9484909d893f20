"""Main-text extraction with wrappers: union-free regular expressions inferred from the pages of a host.

A page is a nested token stream: tags with their class or id, and texts. Aligning a page with its
host's wrapper resolves each mismatch: differing texts become a text slot, tags that only one side
has an optional group, and neighbouring groups with the same tags one repeated group. Wrappers are
folded page by page where the pages lie, then merged per host in two steps, so that a host with very
many pages is shared out; a wrapper's size depends on the template, not on the number of pages.

A page is then matched with its host's wrapper. Menus, headers, footers, adverts and so on are known
by their tags and roles, and by classes that say nothing else. A class or id that has such a word among others (menu-costs may be a
section's subject), and one of a paragraph or heading, decides nothing by itself: the element goes only if the wrapper has it on several pages
with the same text on all. The text is that of the article elements, or where the template has
none, of what is left after the wrapper's constant texts (those that no page of the host varies) go.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ready, table

# HTML's element kinds, and the words that mark what is no main text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
OTHERS = BLOCK - {"p"}
CLOSES_P = BLOCK - set("body html td th tr tbody thead tfoot caption li dd dt".split())
DROPPED = set("aside button canvas datalist dialog footer form head iframe input label map menu nav noscript object option script search select style svg template textarea title".split())
RAW = {t: re.compile(f"(?i)</{t}") for t in "script style textarea title noscript template svg iframe".split()}
MARKS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related reply replies share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
NEUTRAL = set("area bar block box body buttons container content footer form header holder inline inner item items left link links list main panel placeholder posts right section site slot slots text thread title top unit units wrap wrapper".split())
REMARKS = set("ad ads advert comment comments promo promoted related reply replies sponsor sponsored".split())
HOLDERS = set("center dd details div dl dt fieldset figure ins li ol section span table tbody td tr ul".split())
ROLES = set("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
LISTS, HOLDS, PASSES = {"ul", "ol", "dl", "table", "select"}, {"td", "th", "article", "main"}, {"table", "tr", "body", "html", "article", "main"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

START, QUOTED = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))"), re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORDS, SPACE = re.compile(r"[a-z]+"), re.compile(r"\s+")
#: Pages that a constant text must have been seen on, the longest repeated group, hosts held at once, and the deepest nesting that a
#: wrapper knows (what lies deeper is a page's own).
SURE, PERIOD, HOSTS, DEEP = 3, 4, 2000, 150
#: Bytes of all wrappers that are broadcast; beyond, hosts are joined in so many salts.
WRAPPERS, SALTS = 32 << 20, 64


class Node:
    """An element (label: its tag with class and id) with its children; a text (tag "") with its value.

    marked: it is no main text; perhaps: it is none if the wrapper says so.
    """

    __slots__ = ("kids", "label", "marked", "perhaps", "tag", "text")

    def __init__(self, tag: str, label: str = "", text: str = "", marked: bool = False, perhaps: bool = False):
        self.tag, self.label, self.text, self.marked, self.perhaps, self.kids = tag, label or tag, text, marked, perhaps, []


def _open(tag: str, rest: str) -> Node:
    label, marked, perhaps = tag, tag in DROPPED, False
    if "=" in rest or "hidden" in rest:
        for name, value in ATTRIBUTE.findall(rest):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                # Names with numbers are a page's own; a template's have none.
                label += "".join(("." if name == "class" else "#") + v for v in value.split() if not any(map(str.isdigit, v)))
                for token in value.split():
                    if not MARKS.isdisjoint(words := WORDS.findall(token)):
                        perhaps = True
                        marked = marked or (tag in HOLDERS and MARKS.union(NEUTRAL).issuperset(words))
            elif name == "role":
                marked = marked or value in ROLES
            else:
                marked = marked or (name == "hidden" and not value) or (name == "aria-hidden" and value == "true")
    return Node(tag, label, marked=marked, perhaps=perhaps and not marked)


def parse(page: str) -> Node:
    """The page's tree; unclosed paragraphs, items and cells end where HTML ends them, and stray end tags are passed over."""
    top = Node("html")
    open_, at, pos = [top], 0, 0
    places: dict[str, list[int]] = {}  # where the open elements of a tag are, so that no depth makes a search long
    last, quotes, plain = page.rfind(">"), {q: page.rfind(q) for q in "\"'"}, False

    def text(upto: int) -> None:
        if upto > at:
            if (value := page[at:upto]).strip():
                open_[-1].kids.append(Node("", text=value))
            elif open_[-1].kids:
                open_[-1].kids.append(Node("", text=" "))

    def deepest(tags: set[str]) -> int:
        return max((x[-1] for t in tags if (x := places.get(t))), default=0)

    def end_at(at: int) -> None:
        while len(open_) > at:
            places[open_.pop().tag].pop()

    while m := START.search(page, pos):
        tag = (m[2] or "").lower()
        if page.startswith("<!--", m.start()):
            end = page.find("-->", m.end())
            end = len(page) if end < 0 else end + 3
        elif last < m.end():
            break
        else:
            # Marks of quotation hide what looks like an end. If they don't come out even up to the page's end, they don't count from there on.
            end = -1
            while tag and not m[1] and not plain:
                q = QUOTED.search(page, m.end() if end < 0 else end)
                if q is None:
                    plain, end = True, -1
                elif q[0] == ">":
                    end = q.end()
                    break
                else:
                    end = q.end() if q.start() == quotes[q[0]] else page.find(q[0], q.end()) + 1
            if end < 0:
                end = page.find(">", m.end()) + 1
        text(m.start())
        rest = page[m.end() : end - 1]
        at = pos = end
        if not tag:
            continue
        if not m[1] and tag in RAW:
            if close := RAW[tag].search(page, end):
                pos = at = close.start()
                if (done := page.find(">", at)) >= 0:
                    pos = at = done + 1
                    continue
            at = len(page)
            break
        if m[1]:
            own = (places.get(tag) or [0])[-1]
            if own and (tag in PASSES or own >= deepest(HOLDS - {tag})):
                end_at(own)
        else:
            if tag in CLOSES_P:
                if (places.get("p") or [0])[-1] > deepest(OTHERS):
                    end_at(places["p"][-1])
            elif tag in CLOSED_BY and deepest(CLOSED_BY[tag]) > deepest(LISTS):
                end_at(deepest(CLOSED_BY[tag]))
            node = _open(tag, rest)
            if tag in ("html", "body", "article", "main"):
                node.marked, node.perhaps = tag in ("article", "main") and not REMARKS.isdisjoint(WORDS.findall(node.label)), False
            open_[-1].kids.append(node)
            if tag not in VOID and not rest.endswith("/"):
                places.setdefault(tag, []).append(len(open_))
                open_.append(node)
    text(len(page))
    return top


# A wrapper is a list: label, flags (OPTIONAL, REPEATED), constant text or None for a slot, children, pages it was seen on.
OPTIONAL, REPEATED = 1, 2


def _flat(text: str) -> str:
    return SPACE.sub(" ", text).strip()


def _gist(text: str) -> str:
    """A text as a wrapper remembers it: whole while short, or else its hash."""
    import hashlib

    return text if len(text) < 60 else hashlib.md5(text.encode("utf-8", "replace")).hexdigest()


def wrapper_of(node: Node, deep: int = DEEP) -> list:
    """The wrapper that a single page is, down to so many levels."""
    kids = [wrapper_of(k, deep - 1) for k in node.kids if k.tag or not k.text.isspace()] if deep else []
    return [node.label if node.tag else "", 0, None if node.tag else _gist(_flat(node.text)), _fold_repeats(kids), 1]


def _fold_repeats(kids: list[list], join=None) -> list[list]:
    """kids with neighbouring groups that have the same labels folded, by merge or join, into one repeated group each."""
    join = join or merge
    for period in range(1, PERIOD + 1):
        out: list[list] = []
        i, n = 0, len(kids)
        while i < n:
            group = kids[i : i + period]
            names = [k[0] for k in group]
            i += period if len(group) == period else n - i
            times = 1
            while len(group) == period and any(names) and [k[0] for k in kids[i : i + period]] == names:
                group = [join(a, b) for a, b in zip(group, kids[i : i + period], strict=True)]
                i, times = i + period, times + 1
            if times > 1:
                for k in group:
                    k[1] |= REPEATED
                out += group
            else:
                out.append(group[0])
                i -= len(group) - 1
        kids = out
    return kids


def merge(a: list, b: list, pages: bool = False) -> list:
    """The least general of these expressions that covers both a and b, which have the same label; pages: they come from different pages."""
    text = a[2] if a[2] == b[2] else None
    return [a[0], a[1] | b[1], text, _align(a[3], b[3], pages), a[4] + b[4] if pages else max(a[4], b[4])]


def _align(a: list[list], b: list[list], pages: bool) -> list[list]:
    """Children lists aligned by label: what one side lacks becomes optional."""
    x, y = [k[0] for k in a], [k[0] for k in b]
    if x == y:
        return [merge(p, q, pages) for p, q in zip(a, b, strict=True)]
    from difflib import SequenceMatcher

    out = []
    for op, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if op == "equal":
            out += [merge(p, q, pages) for p, q in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [[p[0], p[1] | OPTIONAL, *p[2:]] for p in a[i:j] + b[k:m]]
    return _fold_repeats(out)


def join_wrappers(a: list | None, b: list) -> list:
    """Two wrappers of a host as one."""
    return b if a is None else merge(a, b, True)


def _matched(kids: list[Node], like: list | None) -> dict[int, list]:
    """For a page's children, by id, the wrapper's child that each is aligned with, as wrappers are aligned; what the wrapper lacks has none."""
    if like is None:
        return {}
    folded = _fold_repeats([[k.label if k.tag else "", 0, [k]] for k in kids if k.tag or not k.text.isspace()], lambda a, b: [a[0], a[1], a[2] + b[2]])
    x, y = [w[0] for w in like[3]], [f[0] for f in folded]
    same = [(0, 0, len(x))]
    if x != y:
        from difflib import SequenceMatcher

        same = SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()
    return {id(k): like[3][i + d] for i, j, n in same for d in range(n) for k in folded[j + d][2]}


def _has_slot(wrapper: list) -> bool:
    return (not wrapper[0] and wrapper[2] is None) or any(map(_has_slot, wrapper[3]))


def _blocks(top: Node, wrapper: list | None) -> Iterator[str]:
    """The main text's blocks in page order."""
    order = [top]
    for node in order:  # grows as it goes
        order += [k for k in node.kids if k.tag]
    holds: dict[int, bool] = {}  # whether a main element lies inside
    for node in reversed(order):
        holds[id(node)] = any(holds[id(k)] or (k.tag in ("article", "main") and not k.marked) for k in node.kids if k.tag)
    asked = any(n.perhaps for n in order)
    # Without any slot the host's pages are copies of one, and nothing tells template from text.
    sure = wrapper is not None and _has_slot(wrapper)
    line: list[str] = []
    out: list[str] = []

    def flush() -> None:
        if line:
            if block := _flat(html.unescape("".join(line))):
                out.append(block)
            line.clear()

    def fixed(like: list | None) -> bool:
        return sure and like is not None and like[4] >= SURE and not _has_slot(like)

    wanted = holds[id(top)]
    # What is still to be read, the next last: an element with its wrapper, or the end of a block.
    ahead: list = [(top, wrapper, False, False)]
    while ahead:
        if (now := ahead.pop()) is None:
            flush()
            continue
        node, like, inside, article = now
        if not node.tag:
            if inside or (not wanted and not (like is not None and like[4] >= SURE and like[2] == _gist(_flat(node.text)))):
                line.append(node.text)
            continue
        if (node.marked or (node.perhaps and fixed(like))) and not holds[id(node)]:
            continue
        if node.tag == "header" and not article and not holds[id(node)]:
            continue
        inside = inside or (not holds[id(node)] and node.tag in ("article", "main")) or (node.tag == "article" and not node.marked)
        article = article or node.tag == "article"
        if node.tag == "br":
            line.append(" ")
        if node.tag in BLOCK:
            flush()
            ahead.append(None)
        # Where there are articles, their texts all stay, and the wrapper is asked only about what may be none.
        of = _matched(node.kids, like) if sure and (asked or not wanted) else {}
        ahead += [(k, of.get(id(k)), inside, article) for k in reversed(node.kids)]
    flush()
    yield from out


def extract(page: str, wrapper: list | None = None) -> str:
    """The main text of a page; "" where there is none."""
    return "\n\n".join(_blocks(parse(page), wrapper))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, wrapper) of the pages of a partition."""
    held: dict[str, list] = {}

    def out() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())], ["host", "wrapper"])
        held.clear()
        return rows

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[host] = join_wrappers(held.get(host), wrapper_of(parse(page)))
            if len(held) >= HOSTS:
                yield out()
    if held:
        yield out()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One (host, wrapper) of each run of rows with the same host."""
    host, whole = None, None
    for batch in batches:
        done = []
        for h, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if h != host and whole is not None:
                done.append((host, json.dumps(whole)))
                whole = None
            host, whole = h, join_wrappers(whole, json.loads(w))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done, strict=True)], ["host", "wrapper"])
    if whole is not None:
        yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([json.dumps(whole)], pa.string())], ["host", "wrapper"])


def host() -> F.Column:
    """The host of the url column, in lower case; "" without one."""
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): the wrapper of every host as JSON, from all its pages. Pages without a url have host ""."""
    ready(pages.sparkSession)
    parts = pages.select(host().alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(_partial, "host string, wrapper string")
    parts = cut(parts)
    dealt = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(64))).repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").drop("salt")
    some = dealt.mapInArrow(_merged, "host string, wrapper string")
    return some.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(_merged, "host string, wrapper string")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page, n_chars its code points.

    A null or empty html gives the empty text. Rows that repeat are each answered, and a null page_id or url is returned as it is; pages without a url
    share a wrapper. Pages of any length and nesting are read whole, in time in proportion. An empty table gives no rows; other columns are passed over.
    """
    known = cut(wrappers(pages))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host().alias("host"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, list] = {}
        for batch in batches:
            texts = []
            for page, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if w is not None and w not in read:
                    if len(read) >= HOSTS:
                        read.clear()
                    read[w] = json.loads(w)
                texts.append(extract(page, read.get(w)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    if (known.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0) <= WRAPPERS:
        joined = rows.join(F.broadcast(known), "host", "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
        joined = rows.join(known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    joined = joined.select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op5_html(spark, sf_dir):
    """Each page's main text and its length. A null html gives the empty text; repeated rows are each answered; ties don't arise, as blocks
    keep the page's order; an empty table gives no rows."""
    return main_text(table(ready(spark), sf_dir, "pages"))
