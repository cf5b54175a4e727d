"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is read as a stream of tags and text. Block elements nest; a text between them is a slot, whatever inline
markup it holds. Pages of a host are aligned with the host's wrapper one after the other, level by level: elements
of one name and class at the same place are matched (a longest common subsequence) and aligned in turn; what one
side lacks becomes optional; neighbours of one kind become a repeated group; texts that differ become slots, texts
that are always the same stay part of the template. Alignment runs in the tasks that read the pages, so that only
distinct structures travel, and meets per host in salted groups.

Each page is then matched with its host's wrapper, which gives every text a slot of the expression. A text that
stands in a slot on all pages that have the slot is template; so a menu is found by its slot, also as a repeated
group. Content are the other slots: those inside the main container (article, main) if the host has one, where a
repeated group counts as content whatever recurs in it; else all that are not boilerplate by element or class.
Words of a class are whole tokens; marks around a main container do not outweigh it, and where all of a page is
marked by words, the slots that vary are content.
"""

from __future__ import annotations

import bisect
import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

# Element names of HTML by their role.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BOILERPLATE = frozenset("head nav footer aside form script style title noscript template button select option textarea svg math iframe object canvas audio video dialog menu menuitem xmp noembed noframes".split())
#: Elements that an opening tag of the same group closes.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements beyond which an implied end does not reach.
SCOPE = frozenset("ul ol dl table article main section div body html td th blockquote".split())
#: Words of class, id or role that mark boilerplate.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay comment comments reply replies respond disqus "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer header masthead related recommended share sharing social newsletter subscribe subscription login signup search pagination pager widget toolbar contentinfo complementary".split()
)
MAIN_WORDS = frozenset("main article articlebody article-body post-content entry-content".split())
#: Texts in deeper elements have no slot in a wrapper, so they are content unless they are marked as boilerplate.
MOST_DEPTH = 200
#: Pages that show a constant text a template: two pages of a host may share a sentence by chance or by copying.
TEMPLATE_PAGES = 3
#: Share of a page's unmarked varying text that its main containers must hold to be all of the content.
CONTAINER_SHARE = 0.2
#: Structures that one task aligns at a time; the wrapper is the same kind of expression at any number.
GROUP = 64
#: Pairs up to which sequences are aligned by their longest common subsequence; longer ones are cut at landmarks first.
TABLE = 1 << 18

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?](?:[^>]*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
_ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CUT = re.compile(r"<[a-zA-Z/!?][^>]*\Z")

Node = list  # [label, children, repeated, optional]; a child is a Node or the slot "#"


#: Marks of boilerplate: by a word of class, id or role, and by element.
BY_WORD, BY_TAG = 1, 2


def _marks(name: str, attrs: str) -> tuple[str, int, bool]:
    """(label, boilerplate, main container) of an element; words are whole tokens, and those of the page itself say nothing."""
    label, words = name, set()
    if attrs and "=" in attrs:
        for key, a, b, c in _ATTR.findall(attrs):
            value = (a or b or c).lower()
            if key.lower() == "class" and value:
                label = f"{name}.{'.'.join(sorted(value.split()))}"
            words.update(value.replace("_", "-").split())
    if name in ("html", "body"):
        words = set()
    main = name in ("article", "main") or bool(words & MAIN_WORDS)
    return label, BY_TAG if name in BOILERPLATE else BY_WORD if words & BOILERPLATE_WORDS else 0, main


def read_page(page: str, tree: bool = False, raw: bool = False) -> tuple[list[tuple[str, int, bool, str, int]], Node]:
    """(slots in order, each with path, boilerplate, in main container, text, boilerplate inside that container; structure of the page if ``tree``).

    With ``raw`` neighbours are not folded, and a slot of the structure is its number.
    Never fails: a tag that is cut off at the end is dropped, end tags without a start are passed over.
    """
    slots: list[tuple[str, int, bool, str, int]] = []
    root: Node = ["", [], False, False]
    stack: list[tuple[str, str, int, bool, int, Node]] = [("", "", 0, False, 0, root)]
    parts: list[str] = []
    blank = True

    def flush() -> None:
        nonlocal parts, blank
        if parts:
            if not blank and (text := " ".join(html.unescape("".join(parts)).split())):
                _, path, bad, main, inner, node = stack[-1]
                slots.append((path, bad, main, text, inner))
                if raw:
                    node[1].append(len(slots) - 1)
                elif tree and (not node[1] or node[1][-1] != "#"):
                    node[1].append("#")
            parts, blank = [], True

    def close() -> None:
        *_, node = stack.pop()
        if raw and len(stack) < MOST_DEPTH:
            stack[-1][-1][1].append(node)
        elif tree and len(stack) < MOST_DEPTH:
            _append(stack[-1][-1], node)

    if m := _CUT.search(page, max(0, page.rfind("<"))):
        page = page[: m.start()]
    at = 0
    lower = None
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            blank = blank and piece.isspace()
        at = m.end()
        end, name, attrs = m.groups()
        if name is None:
            continue
        name = name.lower()
        if name in RAW and not end:
            lower = lower or page.lower()
            stop = lower.find(f"</{name}", at)
            at = len(page) if stop < 0 else page.find(">", stop) + 1 or len(page)
            continue
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            continue
        flush()
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    while len(stack) > i:
                        close()
                    break
            continue
        ends = CLOSED_BY.get(name, ())
        for i in range(len(stack) - 1, 0, -1):
            above = stack[i][0]
            if above == "p" or above in ends:
                while len(stack) > i:
                    close()
                break
            if above in SCOPE:
                break
        if name in VOID:
            continue
        label, bad, main = _marks(name, attrs)
        _, path, was_bad, was_main, was_inner, _ = stack[-1]
        if name == "header" and not was_main:
            bad = BY_TAG
        # a main container starts afresh: what surrounds it marks it only in ``bad``
        inner = max(was_inner, bad) if was_main else bad
        stack.append((name, f"{path}/{label}", max(was_bad, bad), was_main or (main and not bad), inner, [label, [], False, False]))
    rest = page[at:]
    parts.append(rest)
    blank = blank and (not rest or rest.isspace())
    flush()
    while len(stack) > 1:
        close()
    return slots, root


def _append(parent: Node, node: Node) -> None:
    """Add a child; neighbours of one kind become a repeated group, their contents aligned."""
    children = parent[1]
    if children and children[-1] != "#" and children[-1][0] == node[0]:
        last = children[-1]
        last[2] = True
        if last[1] != node[1]:
            last[1] = align(last[1], node[1])
    else:
        children.append(node)


def _common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by the table of all pairs."""
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _landmarks(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of the names that stand once in both, as many as are in the same order; else each at its next free place."""
    once = [{n for n, c in Counter(z).items() if c == 1} for z in (x, y)]
    at = {n: j for j, n in enumerate(y)}
    pairs = [(i, at[n]) for i, n in enumerate(x) if n in once[0] and n in once[1]]
    if not pairs:
        places: dict[str, list[int]] = {}
        for j, n in enumerate(y):
            places.setdefault(n, []).append(j)
        out, j = [], 0
        for i, n in enumerate(x):
            if (where := places.get(n)) and (k := bisect.bisect_left(where, j)) < len(where):
                out.append((i, where[k]))
                j = where[k] + 1
        return out
    tails: list[int] = []
    back: list[tuple[int, int]] = []  # (pair at the tail, place in back of the one before)
    ends: list[int] = []
    for p, (_, j) in enumerate(pairs):
        k = bisect.bisect_left(tails, j)
        back.append((p, ends[k - 1] if k else -1))
        tails[k : k + 1] = [j]
        ends[k : k + 1] = [len(back) - 1]
    out, k = [], ends[-1]
    while k >= 0:
        p, k = back[k]
        out.append(pairs[p])
    return out[::-1]


def paired(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of equal names in the same order in both; memory grows with the lengths, not with their product.

    Equal ends are paired first. What is left is cut at landmarks until a table of ``TABLE`` pairs holds a part.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= TABLE:
            out += [(a + i, c + j) for i, j in _common(x[a:b], y[c:d])]
            continue
        marks = [(a + i, c + j) for i, j in _landmarks(x[a:b], y[c:d])]
        out += marks
        # gaps between landmarks; without any there is nothing to pair
        for (i, j), (k, m) in zip([(a - 1, c - 1), *marks], [*marks, (b, d)], strict=True) if marks else ():
            if k - i > 1 and m - j > 1:
                todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def align(a: list, b: list) -> list:
    """One sequence that matches both: matched parts aligned in turn, the others optional, neighbours folded."""
    if a == b:
        return a
    name = lambda x: x if x == "#" else x[0]
    only = lambda z: "#" if z == "#" else [z[0], z[1], z[2], True]
    out: list = []
    i = j = 0
    for p, q in [*paired([name(z) for z in a], [name(z) for z in b]), (len(a), len(b))]:
        out += [only(z) for z in (*a[i:p], *b[j:q])]
        if p < len(a):
            out.append("#" if a[p] == "#" else [a[p][0], align(a[p][1], b[q][1]), a[p][2] or b[q][2], a[p][3] or b[q][3]])
        i, j = p + 1, q + 1
    folded: list = []
    for item in out:
        if folded and name(folded[-1]) == name(item):
            if item != "#":
                last = folded[-1]
                folded[-1] = [last[0], align(last[1], item[1]), True, last[3] and item[3]]
        else:
            folded.append(item)
    return folded


def expression(items: list) -> str:
    """The wrapper as a regular expression over tags: (..)+ repeated, (..)? optional, both ((..)+)?, # a text slot."""
    out = []
    for x in items:
        if x == "#":
            out.append("#")
        else:
            body = f"<{x[0]}>{expression(x[1])}</{x[0].split('.')[0]}>"
            body = f"({body})+" if x[2] else body
            out.append(f"({body})?" if x[3] else body)
    return "".join(out)


def has_main(items: list) -> bool:
    """Whether some element of the wrapper is a main container with a slot in it."""

    def slot(children: list) -> bool:
        return any(c == "#" or slot(c[1]) for c in children)

    return any(x != "#" and ((x[0].split(".")[0] in ("article", "main") or bool(set(x[0].split(".")[1:]) & MAIN_WORDS)) and slot(x[1]) or has_main(x[1])) for x in items)


class Wrapper:
    """A host's wrapper with its slots numbered in order, and whether each stands in a repeated group."""

    def __init__(self, items: list):
        self.repeated: list[bool] = []
        self.items = self._numbered(items, False)

    def _numbered(self, items: list, repeated: bool) -> list[tuple]:
        out = []
        for x in items:
            if x == "#":
                out.append(("#", len(self.repeated)))
                self.repeated.append(repeated)
            else:
                out.append((x[0], self._numbered(x[1], repeated or x[2])))
        return out

    def places(self, root: Node, n: int) -> list[int]:
        """The slot of each of the ``n`` texts of a page (its raw structure ``root``), -1 for one that does not match."""
        out = [-1] * n
        todo = [(root[1], self.items)]
        while todo:
            children, items = todo.pop()
            groups: list[tuple[str, list]] = []
            for c in children:
                name = "#" if isinstance(c, int) else c[0]
                if not groups or groups[-1][0] != name:
                    groups.append((name, []))
                groups[-1][1].append(c)
            for (_, members), (name, inner) in _matched(groups, items):
                if name == "#":
                    for c in members:
                        out[c] = inner
                else:
                    todo.extend((c[1], inner) for c in members)
        return out


def _matched(groups: list[tuple], items: list[tuple]) -> list[tuple[tuple, tuple]]:
    """Pairs of one kind in the order of both: each group at the first place it fits, or the most that can be paired."""
    out, j = [], 0
    for g in groups:
        while j < len(items) and items[j][0] != g[0]:
            j += 1
        if j == len(items):
            break
        out.append((g, items[j]))
        j += 1
    if len(out) == len(groups):
        return out
    return [(groups[i], items[j]) for i, j in paired([g[0] for g in groups], [x[0] for x in items])]


def _checksum(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


def content(page: str, main_known: bool, template: dict[int, set[int]], wrapper: Wrapper | None = None) -> str:
    """Text of a page under its host's wrapper; blocks in order, one a line.

    ``template`` has the checksums of the texts that a slot of the wrapper holds on every page.
    """
    slots, root = read_page(page, raw=True)
    places = wrapper.places(root, len(slots)) if wrapper else [-1] * len(slots)
    fixed = [_checksum(s[3]) in template.get(at, ()) for s, at in zip(slots, places, strict=True)]
    if main_known and (inside := [i for i, (_, bad, main, _, _) in enumerate(slots) if main and not bad]):
        # inside the container a repeated group is content
        kept = [i for i in inside if not fixed[i] or wrapper.repeated[places[i]]] or inside
        beside = [i for i, (_, bad, main, _, _) in enumerate(slots) if not main and not bad and not fixed[i]]
        size = lambda of: sum(len(slots[i][3]) for i in of)
        # a container with little of the page's text is a teaser, and what stands beside it is content as well
        if size(kept) < CONTAINER_SHARE * (size(kept) + size(beside)):
            kept = sorted([*kept, *beside])
        return "\n".join(slots[i][3] for i in kept)
    # no container, or only one inside marked elements: the marks around it do not count
    rest = [i for i, (_, bad, main, _, inner) in enumerate(slots) if not bad or (main and not inner)]
    # nothing but marked elements: words are in doubt, and what varies is content
    rest = rest or [i for i, (_, bad, _, _, _) in enumerate(slots) if bad == BY_WORD and not fixed[i]]
    return "\n".join(slots[i][3] for i in [i for i in rest if not fixed[i]] or rest)


def host() -> Column:
    """Host of the column url in lower case; empty for none."""
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit("")))


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (host, structure) and the number of pages of each."""
    for batch in batches:
        seen: dict[tuple[str, str], int] = {}
        for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            _, root = read_page(page or "", tree=True)
            key = (h, json.dumps(root[1], separators=(",", ":")))
            seen[key] = seen.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.string()), pa.array([s for _, s in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["host", "structure", "n"])


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per (host, slot of its wrapper): pages, least and largest checksum of these pages, and the texts all of them have there."""
    for batch in batches:
        wrappers: dict[str, Wrapper] = {}
        held: dict[tuple[str, int], list] = {}
        for i, (h, page) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("host", "html")), strict=True)):
            if h not in wrappers:
                wrappers[h] = Wrapper(json.loads(batch.column("structure")[i].as_py() or "[]"))
            slots, root = read_page(page or "", raw=True)
            texts: dict[int, set[int]] = {}
            for slot, at in zip(slots, wrappers[h].places(root, len(slots)), strict=True):
                if at >= 0:
                    texts.setdefault(at, set()).add(_checksum(slot[3]))
            v = _checksum(page or "")
            for at, found in texts.items():
                if (x := held.get((h, at))) is None:
                    held[h, at] = [1, v, v, found]
                else:
                    x[:] = [x[0] + 1, min(x[1], v), max(x[2], v), x[3] & found]
        cols = [[h for h, _ in held], [at for _, at in held], *([x[i] for x in held.values()] for i in range(3)), [sorted(x[3]) for x in held.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _FILLED.types, strict=True)], schema=_FILLED)


_FILLED = pa.schema([("host", pa.string()), ("slot", pa.int32()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("texts", pa.list_(pa.int64()))])


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """One structure that matches all of a group, and the number of pages behind it."""
    items: list = []
    for i, s in enumerate(sorted(group["structure"])):
        items = align(items, json.loads(s)) if i else json.loads(s)
    return pd.DataFrame({"host": [group["host"].iloc[0]], "structure": [json.dumps(items, separators=(",", ":"))], "n": [int(group["n"].sum())]})


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = [json.loads(s) for s in batch.column("structure").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("structure"), pa.array([expression(x) for x in items], pa.string()), pa.array([has_main(x) for x in items], pa.bool_()), batch.column("n")], names=["host", "structure", "wrapper", "has_main", "n"])


def _beside(pages: DataFrame, w: DataFrame) -> DataFrame:
    """``pages`` with the columns of their host in ``w``, which is sent to the tasks if it is small."""
    size = w.agg(F.coalesce(F.sum(sum((F.coalesce(F.length(F.col(c) if c in ("host", "structure") else F.to_json(c)), F.lit(0)) for c in w.columns if c != "has_main"), F.lit(32))), F.lit(0))).first()[0]
    return pages.join(F.broadcast(w) if size <= 32 << 20 else w, "host", "left")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, structure, wrapper, has_main, n pages, template: map of slot to the checksums of its constant texts) of every host.

    A text is constant if every page that has the slot has the text there: ``TEMPLATE_PAGES`` pages at least, not all alike.
    """
    p = pages.select(host().alias("host"), "html")
    seen = written(p.mapInArrow(_observe, "host string, structure string, n long"), "observed")
    s = written(seen.groupBy("host", "structure").agg(F.sum("n").alias("n")), "structures")
    while (most := s.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        salts = max(1, most // GROUP)
        s = s.withColumn("salt", F.pmod(F.xxhash64("structure"), F.lit(salts)))
        s = written(s.groupBy("host", "salt").applyInPandas(_merge, "host string, structure string, n long"), "structures")
    found = s.mapInArrow(_describe, "host string, structure string, wrapper string, has_main boolean, n long")
    filled = written(_beside(p, s.select("host", "structure")).select("host", "structure", "html").mapInArrow(_fill, "host string, slot int, n long, lo long, hi long, texts array<long>"), "filled")
    slots = filled.groupBy("host", "slot").agg(F.sum("n").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter(f"lo <> hi AND c >= {TEMPLATE_PAGES}")
    texts = filled.select("host", "slot", "n", F.explode("texts").alias("text")).groupBy("host", "slot", "text").agg(F.sum("n").alias("m"))
    const = texts.join(slots, ["host", "slot"]).filter("m = c").groupBy("host", "slot").agg(F.collect_list("text").alias("texts"))
    const = const.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("slot", "texts"))).alias("template"))
    return found.join(const, "host", "left")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[str, tuple[Wrapper, dict[int, set[int]]]] = {}
        texts = []
        for i, (h, page, main) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("host", "html", "has_main")), strict=True)):
            if h not in known:
                known[h] = Wrapper(json.loads(batch.column("structure")[i].as_py() or "[]")), {k: set(v) for k, v in batch.column("template")[i].as_py() or ()}
            wrapper, template = known[h]
            texts.append(content(page or "", bool(main), template, wrapper))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    A null html is empty and gives an empty text; pages without a host share the wrapper of the empty host.
    Repeated rows give a row each.
    """
    w = written(wrappers(pages).select("host", "structure", "has_main", "template"), "wrappers")
    p = _beside(pages.select("page_id", "url", "html", host().alias("host")), w)
    return p.select("page_id", "url", "html", "host", "structure", "has_main", "template").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op9(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
