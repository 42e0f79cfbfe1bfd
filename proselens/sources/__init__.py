"""Where texts come from: files, Markdown, source code, commit logs, diffs."""
