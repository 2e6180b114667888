"""Handles, caches and what a session keeps open."""

import os
import subprocess

import pytest

from quernal.plans import session
from quernal.plans.render import results, symbols, truncated


def test_sources(tmp_path):
    assert session.resolve_source("https://h/x.git", "main").key == "https://h/x.git@main"
    assert session.resolve_source("https://h/x.git").key == "https://h/x.git"
    assert session.resolve_source(str(tmp_path) + "/.").key == os.path.realpath(tmp_path)
    with pytest.raises(ValueError):
        session.resolve_source(str(tmp_path / "missing"))
    a = session.resolve_source(str(tmp_path))
    assert session.cache_dir("r", a, False, "hash") != session.cache_dir("r", a, False, "other")
    assert session.choose_source(None, "d") == "d" and session.choose_source("r", "d") == "r" and session.choose_source(None, None) == os.getcwd()


def test_encoder_precedence():
    assert session.resolve_encoder("flag", "env") == "env" and session.resolve_encoder("flag", "") == "flag"
    assert session.resolve_encoder("", "") == "hash" and session.resolve_encoder("flag", "  ") == "  "


def test_sizes_and_clear(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x").write_bytes(b"0123456789")
    (tmp_path / "a" / "b" / "y").write_bytes(b"01234")
    assert session.dir_size(spark, str(tmp_path)) == 15 and "1 indexes, 15 B" in session.status(spark, str(tmp_path))
    session.clear(spark, str(tmp_path))
    session.clear(spark, str(tmp_path))
    assert not tmp_path.exists()


def test_rendering():
    assert truncated("x" * 2500).endswith("(2000 of 2500 characters)")
    row = {"file_path": "a.rs", "start_line": 1, "end_line": 2, "score": 0.5, "content": "fn a() {}\n"}
    assert "## 1. a.rs:1-2  [score=0.500]\n```rust\nfn a() {}\n```" in results("# q", [row])
    assert "context" in results("# q", [row | {"context": "context"}])
    assert symbols("a", [{"role": "def", "file_path": "a.rs", "line": 1, "kind": "function"}]) == "# a\n## Defined at\n- a.rs:1 (function)"


def test_session_opens_git_and_forgets(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.py").write_text("def alpha():\n    pass\n")
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(tree), *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    held = session.Session(spark, str(tmp_path / "cache"), most=1)
    assert held.get(f"file://{tree}").symbol("alpha").count() == 1
    assert held.get(str(tree)).stats().first().total_chunks == 1
    assert len(held.held) == 1
