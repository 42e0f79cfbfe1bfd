"""Files and folders to segments, manifests of labelled sets, and git as a source."""

from __future__ import annotations

import os
import re
import subprocess
import tomllib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.functions import text as T
from proselens.shipping import ship
from proselens.sources import diffs, markdown, source_code

SKIPPED = {"target", "node_modules", ".git"}
SEGMENT = "seg_id int, kind string, text string, line_start int, line_end int"


def format_of(path: str) -> str | None:
    """markdown, text, a language, or None; by the extension, in any case."""
    name = os.path.basename(path)
    stem, ext = os.path.splitext(name)
    ext = ext[1:].lower()
    if ext in ("md", "markdown"):
        return "markdown"
    if ext == "txt" or not ext and not name.startswith("."):
        return "text"
    return source_code.LANGUAGES.get(ext)


def collect(path: str) -> list[str]:
    """A file itself, or a folder's files by path components; links and build folders are passed over."""
    if os.path.isfile(path):
        return [path]
    out, stack = [], [path]
    while stack:
        with os.scandir(stack.pop()) as entries:
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    if e.name not in SKIPPED:
                        stack.append(e.path)
                elif e.is_file(follow_symlinks=False):
                    out.append(e.path)
    return sorted(out, key=lambda p: p.split(os.sep))


def extract(text: str, kind: str) -> list[dict]:
    """Segments of a text in a format; a plain text is one."""
    if kind == "markdown":
        found = markdown.segments(text)
    elif kind == "text":
        found = [{"kind": "prose", "text": text, "line_start": 1, "line_end": max(1, text.count("\n") + (not text.endswith("\n")))}]
    else:
        found = source_code.segments(text, kind)
    return [{"seg_id": k} | s for k, s in enumerate(found)]


def bound_batches(spark: SparkSession) -> None:
    """Rows and bytes of an Arrow batch, so that long texts fit a worker whatever the input."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def extract_documents(documents: DataFrame) -> DataFrame:
    """documents (doc_id, name, format, text) to segments, of documents in which some segment holds Japanese. Plain texts stay in the JVM."""
    ship(documents.sparkSession)
    bound_batches(documents.sparkSession)
    rows = documents.filter(F.col("format").isNotNull() & T.has_japanese(F.col("text")))

    schema = f"array<struct<{', '.join(x.replace(' ', ':') for x in SEGMENT.split(', ')).replace(', ', ',')}>>"

    @F.pandas_udf(schema)
    def run(text, kind):
        import pandas as pd

        return pd.Series([[] if t is None else extract(t, k) for t, k in zip(text, kind)])

    text, plain = F.col("text"), F.col("format") == "text"
    lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)
    whole = F.array(F.struct(F.lit(0), F.lit("prose"), text, F.lit(1), F.greatest(lines, F.lit(1)))).cast(schema)
    found = rows.select("doc_id", F.col("name").alias("path"), plain.alias("plain"), F.when(plain, whole).otherwise(run(F.when(~plain, text), F.col("format"))).alias("segments"))
    found = found.filter(F.col("plain") | F.exists("segments", lambda s: T.has_japanese(s["text"])))  # a plain text is its one segment
    return found.select("doc_id", "path", F.explode("segments").alias("s")).select("doc_id", "path", "s.*")


def read_files(spark: SparkSession, paths: list[str], settings=None) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, name, format, text), and warnings (path, reason) of files that were named or are no UTF-8.

    Formats and excluded paths are decided on the listing, before any file is opened.
    """
    ship(spark)
    listed, warned = [], []
    for named in paths:
        for p in collect(named):
            if settings is not None and settings.excludes(p):
                continue
            if format_of(p) is None:
                if p == named:
                    warned.append((p, "unsupported"))
                continue
            listed.append((len(listed), p.replace(os.sep, "/"), format_of(p), os.path.abspath(p)))
    rows = spark.createDataFrame(listed, "doc_id long, name string, format string, _path string")
    if not listed:
        docs = rows.select("doc_id", "name", "format", F.lit("").alias("text"))
        return docs, spark.createDataFrame(warned, "path string, reason string")
    # the bytes come through Spark's reader, whose paths every executor can open
    content = spark.read.format("binaryFile").load([_local(p) for *_, p in listed])
    found = content.select(F.regexp_replace("path", "^file:/+", "/").alias("_path"), F.col("content").cast("string").alias("text"))
    read = rows.join(found, "_path")
    docs = read.filter(F.is_valid_utf8("text")).select("doc_id", "name", "format", "text")
    bad = read.filter(~F.is_valid_utf8("text")).select(F.col("name").alias("path"), F.lit("not utf-8").alias("reason"))
    return docs, spark.createDataFrame(warned, "path string, reason string").unionByName(bad)


def _local(path: str) -> str:
    """A path for Spark's reader, which takes these for patterns."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", os.path.abspath(path))


def one_document(spark: SparkSession, text: str, name: str = "<stdin>", kind: str = "text") -> DataFrame:
    return spark.createDataFrame([(0, name, kind, text)], "doc_id long, name string, format string, text string")


# --- git


def git(*args: str, cwd: str = ".") -> bytes:
    done = subprocess.run(["git", "-c", "core.quotepath=false", *args], cwd=cwd, capture_output=True)
    if done.returncode:
        raise RuntimeError(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def commit_log(spec: str | None = None, count: int | None = None, cwd: str = ".") -> str:
    """The log of `a..b`, of a single revision, or of the last count commits (one by default)."""
    rev = ["-n", str(count or 1)] if spec is None else [spec] if ".." in spec else ["-n", "1", spec]
    return git("log", "--format=%H%x00%B%x00", *rev, cwd=cwd).decode("utf-8", "replace")


def diff_range(spec: str) -> tuple[str, str]:
    """What to diff, and the revision whose files to read."""
    if ".." not in spec:
        return f"{spec}~1..{spec}", spec
    return spec, spec.rsplit("..", 1)[1] or "HEAD"


def diff(spec: str | None = None, cwd: str = ".") -> tuple[str, str]:
    """A diff without context, of the index or a range, and the revision ('' for the index) of its files."""
    options = ["-U0", "--diff-filter=AM", "--no-renames", "--no-color", "--no-ext-diff", "--no-textconv", "--src-prefix=a/", "--dst-prefix=b/", "--ignore-submodules"]
    what, rev = (["--cached"], "") if spec is None else ([diff_range(spec)[0]], diff_range(spec)[1])
    return git("diff", *options, *what, cwd=cwd).decode("utf-8", "replace"), rev


def blob(rev: str, path: str, cwd: str = ".") -> str | None:
    try:
        return git("show", f"{rev}:{path}", cwd=cwd).decode("utf-8")
    except UnicodeDecodeError:
        return None


def toplevel(cwd: str = ".") -> str:
    return git("rev-parse", "--show-toplevel", cwd=cwd).decode().strip()


def diff_documents(spark: SparkSession, spec: str | None = None, settings=None, cwd: str = ".") -> tuple[DataFrame, DataFrame]:
    """Segments of what the index (no spec) or a range adds, and warnings (path, reason). The files come from the index or the
    range's right-hand revision, never from the work tree; excluded ones are left out by their path below the repository's root."""
    text, rev = diff(spec, cwd)
    added = diffs.changes(spark.createDataFrame([(0, text)], "diff_id int, diff string"), ["diff_id"]).select("path", "start", "end")
    top, rows, warned = toplevel(cwd), [], []
    for r in added.select("path").distinct().orderBy("path").toLocalIterator():  # the paths that git has named
        if format_of(r.path) is None or settings is not None and settings.excludes(os.path.join(top, r.path)):
            continue
        try:
            content = blob(rev, r.path, cwd)
        except RuntimeError as e:
            warned.append((r.path, str(e)))
            continue
        if content is None:
            warned.append((r.path, "not utf-8"))
        else:
            rows.append((len(rows), r.path, format_of(r.path), content))
    docs = spark.createDataFrame(rows, "doc_id long, name string, format string, text string")
    return diffs.change_segments(extract_documents(docs), added, rev or None), spark.createDataFrame(warned, "path string, reason string")


def hook_path(cwd: str = ".") -> str:
    return os.path.join(os.path.abspath(cwd), git("rev-parse", "--git-path", "hooks", cwd=cwd).decode().strip(), "commit-msg")


HOOK_MARK = "# proselens hook"


def _hook(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except FileNotFoundError:
        return None


def install_hook(force: bool = False, cwd: str = ".") -> tuple[str, bool]:
    """The hook's path, and whether it was written: one that others have made stays unless forced."""
    path = hook_path(cwd)
    found = _hook(path)
    if found is not None and HOOK_MARK not in found and not force:
        return path, False
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'#!/bin/sh\n{HOOK_MARK}\nexec python -m proselens hook commit-msg "$@"\n')
    os.chmod(path, 0o755)
    return path, True


def uninstall_hook(cwd: str = ".") -> str | None:
    """The removed hook's path, if it was one of ours."""
    path = hook_path(cwd)
    if HOOK_MARK not in (_hook(path) or ""):
        return None
    os.remove(path)
    return path


# --- manifests


@dataclass(frozen=True)
class CorpusSet:
    name: str
    side: str
    paths: tuple[str, ...] = ()
    commits: str | None = None
    judge: bool = True


def manifest(path: str) -> list[CorpusSet]:
    """Labelled sets of a TOML file; each has paths or a saved commit log, relative to the file."""
    with open(path, "rb") as f:
        data = tomllib.load(f)
    if set(data) - {"set"}:
        raise ValueError(f"{path}: unknown keys {sorted(set(data) - {'set'})}")
    base, out = os.path.dirname(os.path.abspath(path)), []
    for s in data.get("set", []):
        if unknown := set(s) - {"name", "side", "paths", "commits", "judge"}:
            raise ValueError(f"{path}: unknown keys {sorted(unknown)}")
        if s.get("side") not in ("human", "claude"):
            raise ValueError(f"{path}: the side is human or claude")
        if ("paths" in s) == ("commits" in s):
            raise ValueError(f"{path}: {s.get('name')} takes either paths or commits")
        commits = os.path.join(base, s["commits"]) if "commits" in s else None
        out.append(CorpusSet(s["name"], s["side"], tuple(os.path.join(base, p) for p in s.get("paths", [])), commits, s.get("judge", True)))
    return out
