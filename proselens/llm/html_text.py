"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A page is parsed into its block elements (inline markup belongs to the block around it). Each block
has features of its subtree's density, its attribute tokens and those above it, its depth and its
siblings; boosted trees give the log odds that main text lies in it. Decoding chooses, from the leaves
up, whether a whole subtree goes or the block stays and its children choose for themselves, so no
descendant of a dropped block is kept and no block is kept against all of its content. The trees are fitted, deterministically, on
pages composed by `layouts` from many page plans; the training set is of a fixed size.

Defined results: null, empty and text-less pages give the empty string; any input parses; scripts, styles,
templates, comments, controls and embedded objects never have text; white space is one space, blocks
are joined by one space; nothing is cut off, whatever the length; where keeping and dropping a block are equally likely it stays. Repeated rows repeat;
other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.llm.boosting import BoostedTrees
from proselens.llm.common import arrow_batches, table
from proselens.llm.layouts import GROUPS, MARK, page

TRAINING_PAGES = 700

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("head script style template noscript svg math iframe object canvas audio video select button textarea datalist dialog".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An element that opens closes an open one of these, up to the given border.
SIBLING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
KINDS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "h", "list", "li", "table", "quote", "other")
KIND = {"h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "ul": "list", "ol": "list", "dl": "list", "menu": "list", "dd": "li", "dt": "li", "tr": "table", "td": "table", "th": "table", "tbody": "table", "blockquote": "quote", "pre": "quote", "figcaption": "quote"}
TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|itemprop|data-role)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
GROUP_OF = {t: k for k, g in enumerate(GROUPS.values()) for t in g}


class Node:
    __slots__ = ("tag", "parent", "items", "groups", "hidden", "depth", "place", "linked", "own", "tags", "n")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.items = tag, parent, []
        self.groups, self.hidden = [0] * len(GROUPS), False
        self.depth = parent.depth + 1 if parent else 0
        self.place, self.linked, self.own, self.tags = 0, 0, 0, 0
        if attrs and "=" in attrs or "hidden" in attrs:
            for name, value in ATTR.findall(attrs):
                name, value = name.lower(), value.strip("\"'")
                if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    self.hidden = True
                elif name != "style":
                    for part in PART.findall(value):
                        k = GROUP_OF.get(part.lower())
                        if k is not None:
                            self.groups[k] += 1


def parse(source: str) -> Node:
    """The tree of block elements. An item of a node is a string or a node; a line break is a space."""
    root = Node("body", None)
    here, inline, at, silent = root, [], 0, None
    lower = None
    scan = TAG.scanner(source)

    def say(raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            here.items.append(text)
            n = len(text.split())
            here.own += n
            if "a" in inline:
                here.linked += n

    opened: dict[str, int] = {}  # tags on the way up, so that what closes nothing does not climb

    def close(to: Node) -> None:
        """Goes up to a node above."""
        nonlocal here
        while here is not to:
            opened[here.tag] -= 1
            here = here.parent
        inline.clear()

    while m := scan.search():
        if silent is None:
            say(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        end, name, attrs = bool(m[1] or m[4]), name.lower(), m[3] or m[6] or ""
        if silent is not None:
            if end and name == silent[0]:
                silent[1] -= 1
            elif not end and name == silent[0] and not attrs.endswith("/"):
                silent[1] += 1
            if silent[0] == "head" and (name == "body" or end and name == "html") or not silent[1]:
                silent = None
            continue
        if end:
            if name in INLINE:
                if name in inline:
                    del inline[len(inline) - 1 - inline[::-1].index(name)]
                continue
            if opened.get(name):
                x = here
                while x.tag != name:
                    x = x.parent
                close(x.parent)
            continue
        here.tags += 1
        if name == "br":
            here.items.append(" ")
            continue
        if name in RAW:
            if lower is None:
                lower = source.lower()
            stop = lower.find(f"</{name}", at)
            if name not in SILENT and name != "title" and stop >= 0:
                say(source[at:stop])
            at = len(source) if stop < 0 else (source.find(">", stop) + 1 or len(source))
            scan = TAG.scanner(source, at)
            continue
        if name in SILENT:
            if not attrs.endswith("/"):
                silent = [name, 1]
            continue
        if name in ("html", "body"):
            continue
        if name in INLINE or name in VOID:
            if name == "hr":
                here.items.append(" ")
            elif name not in VOID:
                inline.append(name)
            continue
        if name in CLOSES_P and opened.get("p"):
            x = here
            while x.tag not in ("p", "body", "td", "th", "div", "article", "section", "main", "aside", "nav", "header", "footer", "form", "li", "blockquote"):
                x = x.parent
            if x.tag == "p":
                close(x.parent)
        if name in SIBLING and any(opened.get(t) for t in SIBLING[name][0]):
            own, border = SIBLING[name]
            x, found = here, None
            while x is not root and x.tag not in border:
                if x.tag in own:
                    found = x
                x = x.parent
            if found is not None:
                close(found.parent)
        node = Node(name, here, attrs)
        here.items.append(node)
        here = node
        opened[name] = opened.get(name, 0) + 1
        inline.clear()
    if silent is None:
        say(source[at:])
    return root


def nodes(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        x.n = len(out)
        out.append(x)
        children = [c for c in x.items if isinstance(c, Node)]
        for k, c in enumerate(children):
            c.place = k
        stack.extend(reversed(children))
    return out


def features(all_: list[Node]) -> np.ndarray:
    n = len(all_)
    up = np.array([x.parent.n if x.parent else 0 for x in all_])
    own = np.array([x.own for x in all_], dtype=np.float64)
    base = np.stack([own, [x.linked for x in all_], [x.tags for x in all_], [x.tag == "p" for x in all_], [x.tag in ("li", "dd", "dt") for x in all_], [(x.tag == "p") * x.own for x in all_], np.ones(n), [sum(t.count(",") + t.count(".") for t in x.items if isinstance(t, str)) for x in all_]], axis=1).astype(np.float64)
    groups = np.array([x.groups for x in all_], dtype=np.float64) > 0
    sub, above, below = base.copy(), groups.copy(), groups.astype(np.float64) * own[:, None]
    silent = np.array([x.hidden for x in all_])
    for k in range(n - 1, 0, -1):  # children stand behind their parents
        sub[up[k]] += sub[k]
        below[up[k]] += below[k]
    kind = np.array([KINDS.index(KIND.get(x.tag, x.tag)) if KIND.get(x.tag, x.tag) in KINDS else len(KINDS) - 1 for x in all_])
    kinds = kind[:, None] == np.arange(len(KINDS))
    ancestor = kinds[:, :8].copy()
    before = np.zeros(n)
    run = np.cumsum(own) - own
    for k in range(1, n):
        above[k] |= above[up[k]]
        ancestor[k] |= ancestor[up[k]]
        silent[k] |= silent[up[k]]
        before[k] = run[k]
    words, total = sub[:, 0], max(1.0, sub[0, 0])
    count = np.bincount(up[1:], minlength=n).astype(np.float64) if n > 1 else np.zeros(n)
    brothers, place = np.where(np.arange(n) > 0, count[up], 1), np.array([x.place for x in all_], dtype=np.float64)
    largest = np.zeros(n)
    for k in range(1, n):
        largest[up[k]] = max(largest[up[k]], words[k])
    ratio = lambda a, b: a / np.maximum(b, 1.0)
    cols = [
        np.log1p(words), np.log1p(own), ratio(sub[:, 1], words), ratio(sub[:, 2], words), np.log1p(sub[:, 3]), np.log1p(sub[:, 4]), ratio(sub[:, 5], words), np.log1p(sub[:, 6]), ratio(sub[:, 7], words),
        words / total, before / total, ratio(words, sub[up, 0]), np.where(np.arange(n) > 0, ratio(words, largest[up]), 1.0), np.array([x.depth for x in all_], dtype=np.float64), place, ratio(place, brothers), brothers, silent,
        ratio(words, np.maximum(sub[:, 6], 1)), ratio(sub[up, 1], sub[up, 0]),
    ]
    return np.concatenate((np.stack([np.asarray(c, dtype=np.float64) for c in cols], axis=1), kinds, ancestor, groups, above, below / np.maximum(words, 1)[:, None]), axis=1)


def decode(all_: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes stay: the choice of greatest likelihood in which what is below a dropped node is dropped."""
    n = len(all_)
    weight = np.array([1.0 + np.log1p(x.own) for x in all_])
    keep, drop = -np.logaddexp(0, -odds) * weight, -np.logaddexp(0, odds) * weight
    for k in range(n - 1, 0, -1):
        p = all_[k].parent.n
        keep[p] += max(keep[k], drop[k])
        drop[p] += drop[k]
    stay = keep >= drop
    for k in range(1, n):
        stay[k] &= stay[all_[k].parent.n]
    return stay


def text_of(root: Node, stay: np.ndarray) -> str:
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif stay[x.n]:
            out.append(" ")
            stack.append(" ")
            stack.extend(reversed(x.items))
    return " ".join("".join(out).split())


def extract(sources: list[str | None], model: BoostedTrees) -> list[str]:
    trees = [nodes(parse(s or "")) for s in sources]
    odds = model.decision(np.concatenate([features(t) for t in trees]))
    out, at = [], 0
    for t in trees:
        out.append(text_of(t[0], decode(t, odds[at : at + len(t)])))
        at += len(t)
    return out


@lru_cache(maxsize=1)
def trained(pages: int = TRAINING_PAGES) -> BoostedTrees:
    """Fitted on composed pages, in which every main text carries marked words."""
    xs, ys = [], []
    for seed in range(pages):
        tree = nodes(parse(page(seed)))
        main = np.zeros(len(tree))
        for x in reversed(tree):
            if any(MARK in t for t in x.items if isinstance(t, str)):
                main[x.n] = 1
            if x.parent and main[x.n]:
                main[x.parent.n] = 1
        xs.append(features(tree))
        ys.append(main)
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys))


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Per row: the id, the columns to keep, text and n_chars (code points)."""
    arrow_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(trained())
    rows = pages.select(F.col(f"`{html_col}`").alias("_html"), F.col(f"`{id_col}`"), *(F.col(f"`{c}`") for c in keep))

    def go(batches):
        import pyarrow as pa

        for b in batches:
            for a in range(0, b.num_rows, 128):
                part = b.slice(a, 128)
                texts = extract(part.column(0).to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=[*part.schema.names[1:], "text", "n_chars"])

    fields = rows.schema.fields[1:]
    return rows.mapInArrow(go, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string, n_chars long")


def op9_html_extraction(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))
