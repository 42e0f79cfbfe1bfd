"""Comments and string literals of source files, as segments.

One lexer for each family of languages; Python's own tokenizer where there is one. Comments on consecutive
lines are one segment. Interpolations and placeholders become as many spaces as they have bytes.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize

from proselens.operators.split import JA, SPACES

LANGUAGES = {"rs": "rust", "py": "python", "ts": "script", "tsx": "script", "js": "script", "jsx": "script", "go": "go"}
PLACEHOLDER = re.compile(r"\$?\{[^{}\s\"'`]*\}|%[-+#.0-9]*[A-Za-z]")
ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|\r?\n[ \t]*|(.))", re.S)
SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "0": ""}
MARKER = re.compile(r"(?:/{2,}!?|#+!?|\*)(?: |$)|/{2,}!?|#+!?")
RUST = re.compile(r'(?P<block>/\*)|(?P<line>//[^\n]*)|(?P<raw>b?r(?P<hash>#*)"(?P<rawbody>.*?)"(?P=hash))|(?P<string>b?c?"(?P<body>(?:[^"\\]|\\.)*)")|(?P<char>\'(?:[^\'\\\n]|\\.[^\']*)\')', re.S)
GO = re.compile(r'(?P<block>/\*.*?\*/)|(?P<line>//[^\n]*)|(?P<raw>`(?P<rawbody>[^`]*)`)|(?P<string>"(?P<body>(?:[^"\\\n]|\\.)*)")|(?P<char>\'(?:[^\'\\\n]|\\.)*\')', re.S)
SCRIPT = re.compile(r'(?P<block>/\*.*?\*/)|(?P<line>//[^\n]*)|(?P<template>`)|(?P<string>"(?P<body>(?:[^"\\\n]|\\.)*)"|\'(?P<body2>(?:[^\'\\\n]|\\.)*)\')', re.S)


def _blank(text: str) -> str:
    return " " * len(text.encode())


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        if code := m[1] or m[2] or m[3] or m[4]:
            try:
                return chr(int(code, 16))
            except ValueError:
                return ""
        return "" if m[5] is None else SIMPLE.get(m[5], m[5])

    return ESCAPE.sub(one, text)


def literal(body: str, raw: bool) -> str:
    return PLACEHOLDER.sub(lambda m: _blank(m[0]), body if raw else unescape(body))


def comment(text: str) -> str:
    """A comment's prose: markers off each line, lines joined; a line without a body parts paragraphs."""
    if text.startswith("/*"):
        text = re.sub(r"^/\*[*!]?|\*/$", "", text)
    out = ""
    for line in text.split("\n"):
        line = line.strip(SPACES)
        m = MARKER.match(line)
        line = line[m.end() :].strip(SPACES) if m else line
        if not line:
            out += "" if not out or out.endswith("\n") else "\n"
        elif not out or out.endswith("\n"):
            out += line
        else:
            out += (" " if out[-1].isascii() or line[0].isascii() else "") + line
    return out.rstrip(SPACES)


def _rust_tests(text: str) -> list[tuple[int, int]]:
    """Ranges of items whose attributes hold cfg(test)."""
    out = []
    for m in re.finditer(r"#\s*\[\s*cfg\s*\(\s*test\s*\)\s*\]", text):
        depth, at = 0, m.end()
        while at < len(text):
            if (x := RUST.match(text, at)) and (x["line"] or x["string"] or x["raw"] or x["char"]):
                at = x.end()
                continue
            if text[at] == "{":
                depth += 1
            elif text[at] == "}" or text[at] == ";" and depth == 0:
                depth -= text[at] == "}"
                if depth == 0:
                    break
            at += 1
        out.append((m.start(), at + 1))
    return out


def _script_template(text: str, at: int) -> tuple[str, int]:
    """A template string from its opening mark: its value, interpolations blanked whole, and its end."""
    out, at = [], at + 1
    while at < len(text) and text[at] != "`":
        if text.startswith("${", at):
            depth, end = 1, at + 2
            while end < len(text) and depth:
                if text[end] == "`":
                    _, end = _script_template(text, end)
                    continue
                if m := re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'').match(text, end):
                    end = m.end()
                    continue
                depth += (text[end] == "{") - (text[end] == "}")
                end += 1
            out.append(_blank(text[at:end]))
            at = end
        elif text[at] == "\\":
            out.append(unescape(text[at : at + 2]))
            at += 2
        else:
            out.append(text[at])
            at += 1
    return "".join(out), at + 1


def _parts(text: str, language: str):
    """start, end, kind, face ('comment' or 'string'), value."""
    pattern, at = {"rust": RUST, "go": GO, "script": SCRIPT}[language], 0
    while m := pattern.search(text, at):
        at = m.end()
        if m["block"] or m["line"]:
            if language == "rust" and m["block"]:  # blocks nest
                depth = 1
                while depth and (x := re.compile(r"/\*|\*/").search(text, at)):
                    depth += 1 if x[0] == "/*" else -1
                    at = x.end()
            body = text[m.start() : at]
            doc = {"rust": r"///(?!/)|//!|/\*\*(?![*/])|/\*!", "script": r"/\*\*(?!/)", "go": r"(?!)"}[language]
            yield m.start(), at, "doc_comment" if re.match(doc, body) else "comment", "comment", body
        elif language == "script" and m["template"]:
            value, at = _script_template(text, m.start())
            yield m.start(), at, "string_literal", "string", PLACEHOLDER.sub(lambda x: _blank(x[0]), value)
        elif language != "script" and m["raw"]:
            yield m.start(), at, "string_literal", "string", literal(m["rawbody"], True)
        elif m["string"]:
            yield m.start(), at, "string_literal", "string", literal(m["body"] if m["body"] is not None else m["body2"], False)


def _python(text: str):
    starts = [0]
    for line in text.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    place = lambda row, col: starts[row - 1] + col
    docs = set()
    try:
        for node in ast.walk(ast.parse(text)):
            if isinstance(node, ast.Module | ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and node.body and isinstance(node.body[0], ast.Expr) and isinstance(node.body[0].value, ast.Constant) and isinstance(node.body[0].value.value, str):
                docs.add(node.body[0].value.lineno)
    except SyntaxError:
        pass
    depth, begin = 0, 0
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                yield place(*t.start), place(*t.end), "comment", "comment", t.string
            elif t.type == tokenize.STRING and depth == 0:
                m = re.match(r"([a-zA-Z]*)('''|\"\"\"|'|\")(.*)\2$", t.string, re.S)
                kind = "doc_comment" if t.start[0] in docs else "string_literal"
                yield place(*t.start), place(*t.end), kind, "string", literal(m[3], "r" in m[1].lower())
            elif t.type == getattr(tokenize, "FSTRING_START", -1):
                begin = place(*t.start) if depth == 0 else begin
                depth += 1
            elif t.type == getattr(tokenize, "FSTRING_END", -1):
                depth -= 1
                if depth == 0:
                    whole = text[begin : place(*t.end)]
                    m = re.match(r"([a-zA-Z]*)('''|\"\"\"|'|\")(.*)\2$", whole, re.S)
                    body = re.sub(r"\{[^{}]*\}", lambda x: _blank(x[0]), m[3])
                    yield begin, place(*t.end), "string_literal", "string", literal(body, "r" in m[1].lower())
    except (tokenize.TokenError, IndentationError, SyntaxError):
        return


def segments(text: str, language: str) -> list[dict]:
    """kind, text, line_start, line_end of comments and strings that hold Japanese."""
    found = list(_python(text)) if language == "python" else list(_parts(text, language))
    tests = _rust_tests(text) if language == "rust" else []
    line = lambda at: text.count("\n", 0, at) + 1
    out: list[list] = []
    for start, end, kind, face, value in sorted(found, key=lambda x: (x[0], -x[1])):
        if any(a <= start < b for a, b in tests):
            continue
        first, last = line(start), line(max(start, end - 1))
        value = value.rstrip("\n")
        if face == "comment" and out and out[-1][4] == "comment" and out[-1][0] == kind and out[-1][3] + 1 == first:
            out[-1][1] += "\n" + (value if not value.startswith("/*") else comment(value))
            out[-1][3] = last
        else:
            out.append([kind, value, first, last, face])
    made = [(k, comment(v) if face == "comment" else v.rstrip(SPACES), a, b) for k, v, a, b, face in out]
    return [{"kind": k, "text": v, "line_start": a, "line_end": b} for k, v, a, b in made if JA.search(v)]
