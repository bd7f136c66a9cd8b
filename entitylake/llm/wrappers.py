"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page is a stream of tags and texts.  Blocks that follow each other with the same tags
fold into a repeated group.  Pages of a host are aligned one after the other with what
has been inferred so far: what only one side has becomes optional, a block that the other
side repeats becomes a repeated group, and texts that differ become slots.  Each task
infers wrappers of the hosts it sees and wrappers are aligned with each other the same
way, so all pages count and no task sees all pages of a host.  Pages of one shape are summed up
first and shapes are aligned in their own order, so the order of pages plays no part.  The
texts that lie in the article are the text, whether they vary or not.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.llm.common import column, lean
from entitylake.llm.licenses import increasing
from entitylake.llm.passages import unused
from entitylake.sources.stage import staged

#: Longest block, in folded tokens, that is looked for as a repetition.
LONGEST_BLOCK = 16
#: Page shapes that a task holds at a time, and groups in which a host's shapes are first aligned.
SHAPES_HELD, FIRST_GROUPS = 2_000, 64
#: Wrappers that a task keeps at hand.
HOSTS_HELD = 2_000
#: Bytes of the hash by which whole constant texts are compared.
HASH_BYTES = 16

#: Fixed values of HTML: elements whose content is no markup, elements without content,
#: elements that end a block, and those that belong to no article.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
OUTSIDE = frozenset("head title nav footer aside form button select option input label dialog menu".split())
BOILERPLATE = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies footer header login masthead menu modal nav navbar "
    "navigation newsletter notice pagination popup promo promotion related reply replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
ARTICLE = frozenset("article main".split())
ARTICLE_NAMES = frozenset("article content entry main post story".split())

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})\b[^>]*(?:>(?:.*?</(?P=raw)\s*>|.*\Z)|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


def stream(html: str) -> tuple[list[str], list[str]]:
    """Symbols of a page's tokens and their texts: ``<div.ad``, ``/div`` or ``#`` with its text."""
    symbols, texts, at = [], [], 0
    for found in TOKEN.finditer(html):
        if found.start() > at and (text := html[at : found.start()]).strip():
            symbols.append("#")
            texts.append(text)
        elif found.start() > at and symbols and symbols[-1] == "#":
            texts[-1] += " "
        at = found.end()
        if name := found["name"]:
            symbols.append(tag(name.lower(), found["close"], found["rest"]))
            texts.append("")
    if html[at:].strip():
        symbols.append("#")
        texts.append(html[at:])
    return symbols, texts


def tag(name: str, close: str, rest: str) -> str:
    """``/div``, or ``<div`` with the words of its class, id and role."""
    if close:
        return f"/{name}"
    if not rest.strip(" /"):
        return f"<{name}"
    names = sorted({n for m in NAMED.finditer(rest) for n in re.findall(r"[a-z]+", m[1].lower())})
    return f"<{'.'.join([name, *names])}"


Node = tuple[str, list]  # shape, and a list of text tokens for each leaf


def fold(symbols: list[str]) -> list[Node]:
    """The stream with each run of equal blocks as one repeated group, ``(block)+``."""
    nodes: list[Node] = [(s, [[i]] if s == "#" else []) for i, s in enumerate(symbols)]
    changed = True
    while changed:
        changed = False
        for width in range(1, LONGEST_BLOCK + 1):
            nodes, once = fold_width(nodes, width)
            changed |= once
    return nodes


def fold_width(nodes: list[Node], width: int) -> tuple[list[Node], bool]:
    shapes = [s for s, _ in nodes]
    out: list[Node] = []
    at, changed = 0, False
    while at < len(nodes):
        block = shapes[at : at + width]
        end = at + width
        if len(block) == width and (block[0][0] == "<" or (block[0][0] == "(" and width > 1)):
            while shapes[end : end + width] == block:
                end += width
        if end > at + width:
            out.append(repeated([nodes[i : i + width] for i in range(at, end, width)]))
            changed = True
            at = end
        else:
            out.append(nodes[at])
            at += 1
    return out, changed


def repeated(blocks: list[list[Node]]) -> Node:
    """One group for blocks of equal shape; a leaf has its texts from all of them."""
    shape = "(" + " ".join(s for s, _ in blocks[0]) + ")+"
    leaves = [[leaf for _, own in block for leaf in own] for block in blocks]
    return shape, [[i for same in leaf for i in same] for leaf in zip(*leaves, strict=True)]


def parts(shape: str) -> list[str]:
    """The shapes at the top of a repeated group's body."""
    found, depth, start = [], 0, 0
    body = shape[1:-2]
    for i, c in enumerate(body + " "):
        depth += (c == "(") - (c == ")")
        if c == " " and not depth:
            found.append(body[start:i])
            start = i + 1
    return found


# A wrapper is {"pages": n, "items": [[shape, optional, [hash of the constant text or None], [characters]]]};
# an item that is not optional is on all its pages.


def join_leaves(a: list, b: list) -> list:
    return [a[0], a[1] or b[1], [x if x == y else None for x, y in zip(a[2], b[2], strict=True)], [x + y for x, y in zip(a[3], b[3], strict=True)]]


def grouped(items: list[list], shapes: set[str]) -> list[list]:
    """Items with each run that one of the repeated groups describes made that group."""
    for shape in sorted((s for s in shapes if s[0] == "("), key=lambda s: (-len(s), s)):
        body = parts(shape)
        own = [i[0] for i in items]
        if body[0] not in own:
            continue
        out, at = [], 0
        while at < len(items):
            run = items[at : at + len(body)]
            if own[at : at + len(body)] == body:
                one = [shape, any(i[1] for i in run), [c for i in run for c in i[2]], [n for i in run for n in i[3]]]
                if out and out[-1][0] == shape:
                    one = join_leaves(out.pop(), one)
                out.append(one)
                at += len(body)
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A common subsequence, as index pairs, without a table of all pairs.

    Equal beginnings and ends match.  Between them, symbols that both sides have once are
    anchors, of which a longest increasing run is kept, and the gaps are matched the same
    way.  In a gap without such symbols the first occurrence of a symbol stands for the
    other side's first, the second for its second, and so on.
    """
    found: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b), True)]
    while gaps:
        i, m, j, n, further = gaps.pop()
        while i < m and j < n and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            found.append((m, n))
        if i == m or j == n or not further:
            continue
        once = {s for s, c in Counter(a[i:m]).items() if c == 1} & {s for s, c in Counter(b[j:n]).items() if c == 1}
        numbered = not once
        place = {}
        seen: Counter = Counter()
        for k, s in enumerate(b[j:n], j):
            if numbered or s in once:
                place[s, seen[s]] = k
                seen[s] += 1
        anchors = []
        seen = Counter()
        for k, s in enumerate(a[i:m], i):
            if (s, seen[s]) in place:
                anchors.append((k, place[s, seen[s]]))
            seen[s] += 1
        anchors = [anchors[k] for k in increasing([y for _, y in anchors])]
        found += anchors
        ends = [(i - 1, j - 1), *anchors, (m, n)]
        gaps += [(x + 1, u, y + 1, v, not numbered) for (x, y), (u, v) in zip(ends, ends[1:], strict=False)]
    return sorted(found)


def align(a: dict, b: dict) -> dict:
    """The wrapper that covers what both cover."""
    left = grouped(a["items"], {i[0] for i in b["items"]})
    right = grouped(b["items"], {i[0] for i in left})
    items, i, j = [], 0, 0
    absent = lambda item: [item[0], True, item[2], item[3]]
    for m, n in [*matches([x[0] for x in left], [x[0] for x in right]), (len(left), len(right))]:
        items += [absent(x) for x in left[i:m]] + [absent(x) for x in right[j:n]]
        if m < len(left):
            items.append(join_leaves(left[m], right[n]))
        i, j = m + 1, n + 1
    return {"pages": a["pages"] + b["pages"], "items": items}


def same_shape(a: dict, b: dict) -> dict:
    """The wrapper of the pages of two that have the same items."""
    return {"pages": a["pages"] + b["pages"], "items": [join_leaves(x, y) for x, y in zip(a["items"], b["items"], strict=True)]}


def hashed(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=HASH_BYTES).hexdigest()


def page_items(nodes: list[Node], texts: list[str]) -> list[list]:
    def leaf(at: list[int]) -> tuple[str | None, int]:
        own = {texts[i].strip() for i in at}
        return hashed(own.pop()) if len(own) == 1 else None, sum(len(texts[i]) for i in at)

    out = []
    for shape, leaves in nodes:
        found = [leaf(at) for at in leaves]
        out.append([shape, False, [c for c, _ in found], [n for _, n in found]])
    return out


def paths(shapes: list[str]) -> list[list[str]]:
    """For each leaf of a wrapper or page the open elements above it."""
    found, open_ = [], []
    for symbol in re.findall(r"[^\s()+]+", " ".join(shapes)):
        if symbol == "#":
            found.append(list(open_))
        elif symbol[0] == "<":
            if symbol[1:].split(".")[0] not in VOID:
                open_.append(symbol[1:])
        else:
            name = symbol[1:]
            for depth in range(len(open_) - 1, -1, -1):
                if open_[depth].split(".")[0] == name:
                    del open_[depth:]
                    break
    return found


def outside(path: list[str]) -> bool:
    """Whether an element above makes the text no part of an article."""
    in_article = False
    for element in path:
        name, *names = element.split(".")
        if name in OUTSIDE or (name == "header" and not in_article) or (name not in ARTICLE | {"body", "html"} and BOILERPLATE & set(names)):
            return True
        in_article |= name in ARTICLE
    return False


def in_article(path: list[str]) -> bool:
    return any(e.split(".")[0] in ARTICLE for e in path)


def article_root(above: list[list[str]], size: list[int], keep: list[bool]) -> list[str]:
    """The innermost element with most of the text, with a preference for one named as content."""
    mass: dict[tuple, int] = {}
    for p, n, k in zip(above, size, keep, strict=True):
        for depth in range(1, len(p) + 1) if k else ():
            mass[tuple(p[:depth])] = mass.get(tuple(p[:depth]), 0) + n
    whole = max(mass.values(), default=0)
    holders = [p for p, n in mass.items() if 2 * n > whole and p[-1].split(".")[0] in BLOCKS - {"p", "li", "td", "tr"}]
    named = [p for p in holders if ARTICLE_NAMES & set(p[-1].split(".")[1:])]
    return list(max(named or holders, key=lambda p: (len(p), p), default=()))


def wanted(wrapper: dict) -> tuple[list[list[bool]], list[str] | None]:
    """For each leaf of each item whether it is article text, and the element that holds the article.

    Article elements decide where the wrapper has any (then there is no such element); else
    the innermost element with most of the host's text does.  Texts that are the same on all
    pages stay: near copies and articles of one series share passages and headings.
    """
    items = wrapper["items"]
    above = paths([i[0] for i in items])
    size = [n for i in items for n in i[3]]
    keep = [not outside(p) for p in above]
    root: list[str] | None = None
    if any(k and in_article(p) for k, p in zip(keep, above, strict=True)):
        keep = [k and in_article(p) for k, p in zip(keep, above, strict=True)]
    else:
        root = article_root(above, size, keep)
        keep = [k and p[: len(root)] == root for k, p in zip(keep, above, strict=True)]
    out, at = [], 0
    for i in items:
        out.append(keep[at : at + len(i[2])])
        at += len(i[2])
    return out, root


def chosen(nodes: list[Node], texts: list[str], wrapper: dict, mask: list[list[bool]], root: list[str] | None) -> set[int]:
    """The text tokens of a page that its host's wrapper has as article text.

    What the wrapper doesn't know stays if it lies in the article.  A page without an article
    element on a host that has them elsewhere goes by its own elements.
    """
    # leaves are numbered, so that their tokens are found again after grouping
    items = [[shape, False, [[i] for i in leaves], [0] * len(leaves)] for shape, leaves in nodes]
    items = joined_groups(items, {i[0] for i in wrapper["items"]})
    pairs = dict((n, m) for m, n in matches([i[0] for i in wrapper["items"]], [i[0] for i in items]))
    above = paths([i[0] for i in items])
    if root is None and any(in_article(p) for p in above):
        inside = [in_article(p) and not outside(p) for p in above]
    else:
        inside = [p[: len(root or ())] == (root or []) and not outside(p) for p in above]
        pairs = pairs if root is not None else {}
    found, at = set(), 0
    for n, item in enumerate(items):
        own = mask[pairs[n]] if n in pairs else inside[at : at + len(item[2])]
        for yes, leaf in zip(own, item[2], strict=True):
            if yes:
                found.update(i for tokens in leaf for i in tokens)
        at += len(item[2])
    return found


def joined_groups(items: list[list], shapes: set[str]) -> list[list]:
    """``grouped`` for items whose leaves hold tokens: those of a run add up."""
    for shape in sorted((s for s in shapes if s[0] == "("), key=lambda s: (-len(s), s)):
        body = parts(shape)
        own = [i[0] for i in items]
        if body[0] not in own:
            continue
        out, at = [], 0
        while at < len(items):
            run = items[at : at + len(body)]
            if own[at : at + len(body)] == body:
                leaves = [leaf for i in run for leaf in i[2]]
                if out and out[-1][0] == shape:
                    leaves = [a + b for a, b in zip(out.pop()[2], leaves, strict=True)]
                out.append([shape, False, leaves, []])
                at += len(body)
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def written(symbols: list[str], texts: list[str], take: set[int]) -> str:
    """The chosen texts as blocks."""
    blocks, current = [], []
    for i, symbol in enumerate(symbols):
        if symbol == "#":
            if i in take:
                current.append(texts[i])
        elif symbol.lstrip("</").split(".")[0] in BLOCKS:
            blocks.append(current)
            current = []
        elif symbol == "<br":
            current.append(" ")
    blocks.append(current)
    clean = (re.sub(r"\s+", " ", unescape("".join(b))).strip() for b in blocks)
    return "\n\n".join(b for b in clean if b)


def wrapper_of(html: str | None) -> dict:
    symbols, texts = stream(html or "")
    return {"pages": 1, "items": page_items(fold(symbols), texts)}


def host(url: str):
    """The host of a URL in lower case; pages without one share the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def infer(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` (as JSON) from ``host, html``: a wrapper per host that all its pages shaped."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "host": pa.array([h for h, _ in held], pa.string()), "shape": pa.array([s for _, s in held], pa.string()),
                "wrapper": pa.array([json.dumps(w) for w in held.values()], pa.string()),
            })

        for batch in batches:
            for h, html in zip(column(batch, "host"), column(batch, "html"), strict=True):
                one = wrapper_of(html)
                key = h, hashed(" ".join(i[0] for i in one["items"]))
                held[key] = same_shape(held[key], one) if key in held else one
                if len(held) >= SHAPES_HELD:
                    yield out()
                    held.clear()
        yield out()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        """The rows of a group by shape: equal shapes are summed up, others aligned in the order of their hashes."""
        shapes: dict[str, dict] = {}
        for shape, text in zip(rows["shape"], rows["wrapper"], strict=True):
            one = json.loads(text)
            shapes[shape] = same_shape(shapes[shape], one) if shape in shapes else one
        total = None
        for _, one in sorted(shapes.items()):
            total = align(total, one) if total else one
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "shape": [min(shapes)], "wrapper": [json.dumps(total)]})

    schema = "host string, shape string, wrapper string"
    found = pages.mapInArrow(lean(local), schema).withColumn("part", F.pmod(F.xxhash64("shape"), F.lit(FIRST_GROUPS)))
    found = found.groupBy("host", "part").applyInPandas(merge, schema)
    return found.groupBy("host").applyInPandas(merge, schema).select("host", "wrapper")


def main_text(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` and ``n_chars`` (code points) of the article.

    Character references are decoded, white space within a block is one space, blocks are
    joined by an empty line.  A null html is empty; a page without a usable URL is one of
    the empty host; a page without an article has an empty text.  Repeated rows are
    returned as often; columns ``text`` and ``n_chars`` are replaced, all others stay.
    """
    kept = pages.drop("text", "n_chars")
    of, by = unused("_host", kept.columns), unused("_wrapper", kept.columns)
    hosted = kept.withColumn(of, host(url))
    # written first, so that Spark knows their size when it plans the join
    wrappers = staged(infer(hosted.select(F.col(of).alias("host"), F.col(html).alias("html"))))
    joined = hosted.join(wrappers.select(F.col("host").alias(of), F.col("wrapper").alias(by)), of, "left").drop(of)
    names = [c for c in kept.columns if c != html]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(column(batch, html), column(batch, by), strict=True):
                if wrapper not in known:
                    if len(known) >= HOSTS_HELD:
                        known.clear()
                    found = json.loads(wrapper)
                    known[wrapper] = (found, *wanted(found))
                symbols, content = stream(page or "")
                take = chosen(fold(symbols), content, *known[wrapper])
                texts.append(written(symbols, content, take))
            out = batch.drop_columns([html, by]).append_column("text", pa.array(texts, pa.string()))
            yield out.append_column("n_chars", pa.array([len(t) for t in texts], pa.int64()))

    schema = ", ".join([*(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in names), "text string", "n_chars long"])
    return joined.select(*names, html, by).mapInArrow(lean(extract), schema)
