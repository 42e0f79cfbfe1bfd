"""Markdown to segments: paragraphs, headings, items and table cells; code, HTML and link targets are no prose.

Two scanners: one finds leaf blocks line by line under a stack of quotes and items, the other walks the inline
notation of a block. What is dropped inside a block becomes as many spaces as it has bytes, so that places stay comparable.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

FENCE = re.compile(r"(`{3,}|~{3,})[^`]*$")
ITEM = re.compile(r"([-+*]|\d{1,9}[.)])(?=[ \t]|$)")
HEADING = re.compile(r"#{1,6}(?=[ \t]|$)[ \t]*")
RULE = re.compile(r"([-*_])[ \t]*(?:\1[ \t]*){2,}$")
UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")
HTML = re.compile(r"<(?:!--|[!?]|/?(?:address|article|aside|blockquote|body|center|details|div|dl|dt|dd|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|iframe|li|link|main|menu|nav|ol|p|pre|script|section|style|summary|table|tbody|td|th|thead|title|tr|ul)(?:[\s/>]|$))", re.I)
DELIMITER = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
DEFINITION = re.compile(r"\[[^\]]+\]:[ \t]*\S")
TASK = re.compile(r"\[[ xX]\][ \t]+")
INLINE = re.compile(r"(?P<code>(?P<tick>`+)(?!`).*?(?<!`)(?P=tick)(?!`))|(?P<auto><[A-Za-z][A-Za-z0-9+.-]*:[^\s<>]*>|<[^\s<>@]+@[^\s<>]+>)|(?P<tag></?[A-Za-z][^<>]*>)|(?P<image>!\[[^\]]*\]\([^)\s]*(?:[ \t]+\"[^\"]*\")?\))|(?P<escape>\\[!-/:-@\[-`{-~])", re.S)
LINK = re.compile(r"\]\([^)\s]*(?:[ \t]+\"[^\"]*\")?\)|\]\[[^\]]*\]")


@dataclass
class Block:
    kind: str = "prose"
    lines: list[tuple[int, str, int]] = field(default_factory=list)  # number, text, width of what stands before it


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def blocks(text: str) -> list[Block]:
    out: list[Block] = []
    stack: list[int] = []  # of open containers: 0 a quote, else the columns of an item's content
    here: Block | None = None
    fence = html = ""
    table = None
    for number, raw in enumerate(text.split("\n"), 1):
        line, at, matched = raw.rstrip("\r").expandtabs(4), 0, 0
        blank = not line.strip()
        for width in stack:
            rest = line[at:]
            if width == 0:
                if not re.match(r" {0,3}>", rest):
                    break
                at += rest.index(">") + 1
                at += line[at : at + 1] == " "
            elif blank or _indent(rest) >= width:
                at = min(len(line), at + width)
            else:
                break
            matched += 1
        rest = line[at:]
        closed = matched < len(stack)
        lazy = closed and here is not None and here.kind == "prose" and not fence
        if fence:
            if closed and not blank:
                fence, stack = "", stack[:matched]
            else:
                fence = "" if re.match(rf" {{0,3}}{re.escape(fence)}+[ \t]*$", rest) else fence
                continue
        if html:
            html = "" if blank else html
            if html:
                continue
        opened = False
        while True:
            body = rest.lstrip(" ")
            if len(rest) - len(body) > 3 and not (here and not opened):
                break
            if body.startswith(">"):
                stack = [*(stack if opened else stack[:matched]), 0]
                matched, opened = len(stack), True
                at += len(rest) - len(body) + 1
                at += line[at : at + 1] == " "
            elif (m := ITEM.match(body)) and not RULE.match(body) and (body[m.end() :].strip() or here is None):
                space = _indent(body[m.end() :])
                width = len(rest) - len(body) + m.end() + (space if 1 <= space <= 4 and body[m.end() :].strip() else 1)
                stack = [*(stack if opened else stack[:matched]), width]
                matched, opened = len(stack), True
                at = min(len(line), at + width)
                if t := TASK.match(line[at:]):
                    at += t.end()
            else:
                break
            rest, here, table = line[at:], None, None
        body = rest.strip()
        if not body:
            here, table = None, None
            continue
        starts = bool(HEADING.match(body) or FENCE.match(body) or HTML.match(body) or RULE.match(body))
        if closed and not opened and not (lazy and not starts):
            stack, here, table = stack[:matched], None, None
        if table is not None and "|" in rest:
            table.append((number, rest))
            continue
        table = None
        if here is None and _indent(rest) >= 4:
            continue
        if m := FENCE.match(body):
            fence, here = m[1], None
        elif (m := HEADING.match(body)) and _indent(rest) < 4:
            out.append(Block(lines=[(number, re.sub(r"[ \t]+#+$|^#+$", "", body[m.end() :]), 0)]))
            here = None
        elif here is not None and UNDERLINE.match(body) and not closed:
            here = None
        elif RULE.match(body):
            here = None
        elif HTML.match(body) and _indent(rest) < 4:
            html = "" if re.search(r"-->|\?>", body) and body.startswith(("<!", "<?")) else "block"
            here = None
        elif here is None and DEFINITION.match(body):
            continue
        elif here is not None and len(here.lines) == 1 and "|" in here.lines[0][1] and DELIMITER.match(body) and "-" in body:
            first = here.lines[0]
            out.remove(here)
            table = [(first[0], first[1])]
            out.append(Block("table", table))  # type: ignore[arg-type]
            here = None
        else:
            if here is None:
                here = Block()
                out.append(here)
            here.lines.append((number, rest.lstrip(" ").rstrip() if here.lines else body, at + _indent(rest)))
    return out


def blanked(text: str, cell: bool) -> str:
    """A block's text with its notation blanked; emphasis stays but in a cell, where arrows go too."""
    mask = bytearray(len(text))
    for m in INLINE.finditer(text):
        if m["escape"]:
            mask[m.start()] = 1
        else:
            mask[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
    lead = 0
    opened: list[int] = []
    k = 0
    while k < len(text):
        if not mask[k]:
            if text[k] == "[":
                opened.append(k)
            elif text[k] == "]" and opened:
                at = opened.pop()
                if m := LINK.match(text, k):
                    mask[at] = 1
                    mask[k : m.end()] = b"\x01" * (m.end() - k)
                    lead = max(lead, 1) if at == 0 else lead
                    k = m.end() - 1
            elif cell and text[k] in "*→":
                mask[k] = 1
        k += 1
    return "".join(" " * len(c.encode()) if mask[i] and c != "\n" else c for i, c in enumerate(text))[lead:]


def _cells(row: str) -> list[str]:
    row = row.strip()
    row = row[1:] if row.startswith("|") else row
    parts = re.split(r"(?<!\\)\|", row)
    return parts[:-1] if row.endswith("|") and not row.endswith("\\|") else parts


def segments(text: str) -> list[dict]:
    """kind, text, line_start, line_end in order."""
    out = []
    for b in blocks(text):
        if b.kind == "table":
            for number, row in b.lines:  # type: ignore[misc]
                out += [("table_cell", blanked(c.strip(), True), number, number) for c in _cells(row)]
        else:
            joined = "\n".join(t if k == 0 else " " * width + t for k, (_, t, width) in enumerate(b.lines))
            out.append(("prose", blanked(joined, False), b.lines[0][0], b.lines[-1][0]))
    return [{"kind": k, "text": t, "line_start": a, "line_end": e} for k, t, a, e in out if t.strip()]
