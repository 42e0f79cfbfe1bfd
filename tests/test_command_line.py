import json
import os
import subprocess

import pytest

from proselens import __main__ as C
from proselens.rulesdata import HEADINGS, RULE_ORDER
from proselens.settings import Settings
from proselens.sources import diffs, files, messages


@pytest.fixture
def repo(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    for k in ("AUTHOR", "COMMITTER"):
        monkeypatch.setenv(f"GIT_{k}_NAME", "n")
        monkeypatch.setenv(f"GIT_{k}_EMAIL", "n@example.org")
    run = lambda *a: subprocess.run(["git", *a], check=True, capture_output=True)
    run("init", "-q", ".")
    (tmp_path / "a.md").write_text("川の幅を測る。\n\n岸の高さを測る。\n\n橋の長さを測る。\n")
    (tmp_path / "skip.md").write_text("橋だ。\n")
    run("add", ".")
    run("commit", "-qm", "始めの題だ。\n\n始めの本文だ。")
    return tmp_path, run


def test_diff_documents(spark, repo):
    path, run = repo
    (path / "a.md").write_text("川の幅を測る。\n\n型がエラーを名乗る。\n\n橋の長さを測る。\n")
    (path / "skip.md").write_text("これは設定です。\n")
    (path / "bad.txt").write_bytes(b"\xff\xfe\n")
    (path / "b.py").write_text("# 窓が開く。\nx = 1\n")
    (path / "pic.png").write_text("型だ。")
    run("add", ".")
    (path / "a.md").write_text("別の文だ。\n")  # the work tree is not looked at
    settings = Settings(exclude=("skip.md",), root=str(path))
    found, warned = files.diff_documents(spark, None, settings)
    rows = sorted((r.path, r.text, r.line_start, r["commit"]) for r in found.collect())
    assert rows == [("a.md", "型がエラーを名乗る。", 3, None), ("b.py", "窓が開く。", 1, None)]
    assert [(r.path, r.reason) for r in warned.collect()] == [("bad.txt", "not utf-8")]
    run("commit", "-qm", "次の題だ。")
    found, _ = files.diff_documents(spark, "HEAD", settings)
    assert {(r.path, r["commit"]) for r in found.collect()} == {("a.md", "HEAD"), ("b.py", "HEAD")}
    draft = messages.message_document(spark, "私は直す。\n\n本文だ。\n")
    both = messages.with_draft(draft, found.limit(0))
    assert {(r.path, r.kind, r.text) for r in both.collect()} == {("<commit-msg>", "commit_subject", "私は直す。"), ("<commit-msg>", "commit_body", "本文だ。")}
    assert messages.message_document(spark, "no prose").count() == 0
    assert files.toplevel() == os.path.realpath(path)


def test_command_line(spark, repo, monkeypatch, capsys):
    path, run = repo
    said = []
    call = lambda *a: (said.clear(), C.run(list(a), spark, said.append))[1]
    assert call("rules") == 0 and said[0].splitlines()[0] == f"S01  structure  3.00  {HEADINGS['S01']}" and len(said[0].splitlines()) == len(RULE_ORDER) == len(HEADINGS)
    (path / "c.md").write_text("型がエラーを名乗る。\n")
    assert call("check", "c.md", "--fail-over", "3", "--json") == 1 and json.loads(said[0])["total"]["by_rule"] == {"S01": 1}
    assert call("commits", "-n", "1", "--summary") == 0 and "始めの題だ。" in said[0]
    run("add", "c.md")
    (path / "msg").write_text("値を変える。\n")
    assert call("hook", "commit-msg", "msg") == 1 and "<commit-msg>" in said[0]  # below the floor, a finding of the first layers is enough
    assert call("hook", "install") == 0 and call("hook", "install") == 0
    hook = path / ".git/hooks/commit-msg"
    assert hook.stat().st_mode & 0o777 == 0o755 and files.HOOK_MARK in hook.read_text()
    assert call("hook", "uninstall") == 0 and not hook.exists() and call("hook", "uninstall") == 0
    hook.write_text("#!/bin/sh\n")
    assert call("hook", "install") == 1 and call("hook", "uninstall") == 0 and hook.read_text() == "#!/bin/sh\n"
    assert call("hook", "install", "--force") == 0 and files.HOOK_MARK in hook.read_text()
    monkeypatch.setattr("sys.argv", ["proselens", "check", "c.md", "--config", "none.toml"])
    assert C.main() == 2 and "誤り" in capsys.readouterr().err


def test_bench(spark, tmp_path):
    (tmp_path / "h.md").write_text("川の幅を測る。" * 60)
    (tmp_path / "c.md").write_text("川の幅を測る。" * 60)
    (tmp_path / "log").write_bytes("abc\x00題だ。\n\n本文だ。\n\x00\n".encode())
    sets = [("h", "human", 'paths = ["h.md"]', "true"), ("c", "claude", 'paths = ["c.md"]', "true"), ("r", "claude", 'paths = ["c.md"]', "false"), ("l", "human", 'commits = "log"', "true"), ("e", "human", "paths = []", "true")]
    (tmp_path / "m.toml").write_text("".join(f'[[set]]\nname = "{n}"\nside = "{s}"\n{p}\njudge = {j}\n' for n, s, p, j in sets))
    said = []
    assert C.run(["bench", str(tmp_path / "m.toml")], spark, said.append) == 1
    lines = said[0].splitlines()
    assert lines[0].split()[:5] == ["集合", "側", "文字数", "文数", "点"] and lines[1].split()[:4] == ["h", "human", "360", "60"]
    notes = lines[lines.index("受け入れ基準を満たさない") + 1 :]
    assert [x.split()[0] for x in notes] == ["h", "参考", "集合が空"] and notes[2] == "  集合が空  e"
    with pytest.raises(ValueError):
        C.run(["bench", str(tmp_path / "m.toml"), "--summary"], spark)


def test_changed_files_without_japanese_go(spark):
    segments = spark.createDataFrame([(1, "a", "plain", 1, 2), (1, "a", "川だ。", 5, 5), (2, "b", "川だ。", 1, 1)], "doc_id long, path string, text string, line_start int, line_end int")
    added = spark.createDataFrame([("a", 2, 3), ("b", 1, 9)], "path string, start int, end int")
    assert [(r.path, r["commit"]) for r in diffs.change_segments(segments, added, "x").collect()] == [("b", "x")]
