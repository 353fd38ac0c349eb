import os
import subprocess
import threading

import pytest

from lodestar import cli
from lodestar.operators import state as st
from lodestar.operators.index import Manifest, Store
from lodestar.operators.search import search
from lodestar.schema import CORPUS, DIRTY
from lodestar.sources import git
from lodestar.streaming.refresh import follow


def sh(repo, *args):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@example.org", *args], check=True, capture_output=True)


@pytest.fixture
def repo(tmp_path):
    sh(tmp_path, "init", "-q")
    (tmp_path / "main.go").write_text("package main\nfunc ALPHA() {}\n")
    (tmp_path / "keep.py").write_text("def steady():\n    pass\n")
    (tmp_path / ".gitignore").write_text("ignored.txt\n")
    sh(tmp_path, "add", "-A")
    sh(tmp_path, "commit", "-qm", "one")
    return tmp_path


@pytest.fixture
def found(spark, repo):
    git.register(spark)
    return lambda text: cli.run(spark, str(repo), text)


def test_reader_takes_regular_files_only(spark, repo):
    (repo / "empty").write_text("")
    (repo / ".hidden").write_bytes(b"\0\1\xff")
    (repo / "a folder").mkdir()
    os.symlink(repo / "main.go", repo / "link")
    os.mkfifo(repo / "pipe")
    (repo / "large").write_bytes(b"x" * (git.MAX_FILE_BYTES + 1))
    (repo / "full").write_bytes(b"x" * git.MAX_FILE_BYTES)
    git.register(spark)
    names = ["empty", ".hidden", "a folder", "link", "pipe", "large", "full", "missing", "main.go", "main.go"]
    rows = spark.read.format("git_worktree").option("names", "\0".join(names)).load(str(repo)).collect()
    assert sorted(r.path for r in rows) == [".hidden", "empty", "full", "main.go", "main.go"]
    assert next(bytes(r.content) for r in rows if r.path == ".hidden") == b"\0\1\xff"
    assert next(len(r.content) for r in rows if r.path == "full") == git.MAX_FILE_BYTES


def test_sources(spark, repo):
    git.register(spark)
    (repo / "a b -> c é.txt").write_text("x")
    (repo / "main.go").write_text("changed")
    dirty = spark.read.format("git_dirty").load(str(repo)).collect()
    assert sorted(r.path for r in dirty) == ["a b -> c é.txt", "main.go"] and len({r.head_sha for r in dirty}) == 1
    committed = {r.path: bytes(r.content).decode() for r in spark.read.format("git_committed").load(str(repo)).collect()}
    assert committed.keys() == {"main.go", "keep.py", ".gitignore"} and "ALPHA" in committed["main.go"]


def test_empty_repository(spark, tmp_path):
    sh(tmp_path, "init", "-q")
    git.register(spark)
    assert spark.read.format("git_committed").load(str(tmp_path)).count() == 0
    assert git.repo_state(str(tmp_path / "nowhere")).head_sha == "no-head"


def test_always_fresh(found, repo):
    assert "## main.go (Go)\n  1 package main\n  2 [func] func ALPHA() {}" == found("ALPHA")
    assert found("qqqq") == ""
    (repo / "main.go").write_text("package main\nfunc BETA() {}\n")
    assert found("ALPHA") == "" and "[uncommitted]" in found("BETA")
    (repo / "main.go").write_text("package main\nfunc GAMMA() {}\n")
    assert found("BETA") == "" and found("GAMMA")
    (repo / "new file.txt").write_text("DELTA\n")
    assert "new file.txt" in found("DELTA")
    (repo / "ignored.txt").write_text("EPSILON\n")
    assert found("EPSILON") == ""
    sh(repo, "add", "-A")
    sh(repo, "commit", "-qm", "two")
    assert "[uncommitted]" not in found("GAMMA") and found("GAMMA")
    (repo / "main.go").unlink()
    assert found("GAMMA") == ""
    sh(repo, "checkout", "main.go")
    assert "[uncommitted]" not in found("GAMMA")


def test_refresh_decisions(spark, repo, tmp_path_factory, monkeypatch):
    git.register(spark)
    root = tmp_path_factory.mktemp("store")
    store, lock = Store(spark, f"file://{root}/s"), str(root / "lock")
    go = lambda: st.refresh(spark, str(repo), store, lock)
    assert not store.exists() and store.manifest() == Manifest()
    assert go() == "committed" and go() == "none"
    (repo / "main.go").write_text("edit")
    assert go() == "overlay" and go() == "none"
    assert {r.path for r in store.read().where("is_overlay").collect()} == {"main.go"}
    sh(repo, "checkout", "main.go")
    assert go() == "clean" and store.manifest().overlay == ""
    (repo / "main.go").write_text("more")
    (repo / "keep.py").write_text("x = 1")
    sh(repo, "commit", "-qm", "two", "keep.py")
    assert go() == "both"

    read = git.read_regular
    (repo / "main.go").write_text("again")

    def moves(*args):
        (repo / "main.go").write_text("moved on meanwhile")
        return read(*args)

    monkeypatch.setattr(st, "worktree_files", lambda *a: (moves(str(repo), "main.go"), spark.createDataFrame([], CORPUS))[1])
    assert go() == "overlay, changed meanwhile" and store.manifest().state == ""
    monkeypatch.undo()
    assert go().endswith("both") and store.manifest().state

    (repo / "main.go").write_text("broken")
    monkeypatch.setattr(st, "worktree_files", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        go()
    assert store.manifest().state == "" and store.exists()
    monkeypatch.undo()
    (root / "s" / "manifest.json").write_text("{damaged")
    assert store.manifest() == Manifest()


def test_a_held_lock(spark, repo, tmp_path):
    path = str(tmp_path / "locks" / "l")
    with st.writer_lock(path, False) as got:
        assert got
        with st.writer_lock(path, True) as second:
            assert second is False
        with pytest.raises(TimeoutError):
            with st.writer_lock(path, False, 0.3):
                pass
    with st.writer_lock(path, False) as got:
        assert got


def test_readers_keep_their_snapshot(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    row = lambda text: spark.createDataFrame([("p", "committed", False, "Go", text)], CORPUS)
    store.publish(Manifest(committed=store.write(row("old"), "committed")))
    before = store.read()
    store.publish(Manifest(committed=store.write(row("new"), "committed")))
    assert before.first().content == "old" and store.read().first().content == "new"
    assert store.write(row("x").where("false"), "overlay") == ""


def test_parallel_searches(spark, repo):
    git.register(spark)
    results = []
    run = lambda: results.append(cli.run(spark, str(repo), "steady"))
    run()
    threads = [threading.Thread(target=run) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(results) == 4 and all("keep.py" in r for r in results)


def test_fingerprint(repo):
    state = git.RepoState("h", "raw", ["main.go", "gone"])
    first = st.fingerprint(str(repo), state)
    assert first.startswith("raw\0main.go\0") and first.endswith("\0gone\0deleted\0") and first.count("\0") == 8
    assert st.fingerprint(str(repo), git.RepoState("h", "raw", [])) == "raw"
    os.utime(repo / "main.go", ns=(1, 1))
    assert st.fingerprint(str(repo), state) != first
    assert st.fingerprint(str(repo), git.RepoState("h", "raw", ["gone", "main.go"])) != st.fingerprint(str(repo), state)
    assert len(st.state_hash(first)) == 16 and st.state_hash("a") != st.state_hash("b")


def test_exit_codes(spark, repo, monkeypatch, capsys):
    monkeypatch.chdir(repo)
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main([]) == 2
    assert cli.main(["(a"]) == 2
    assert cli.main(["--version"]) == 0
    assert cli.main(["qqqq"]) == 1
    capsys.readouterr()
    assert cli.main(["-n", "1", "-m", "1", "steady"]) == 0
    assert capsys.readouterr().out.startswith("## keep.py (Python)\n  1 [function] def steady():")
    monkeypatch.chdir("/")
    assert cli.main(["x"]) == 2


def test_stream_of_changes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    base = spark.createDataFrame([("a", "committed", False, "Go", "old text"), ("b", "committed", False, "Go", "text")], CORPUS)
    store.publish(Manifest(committed=store.write(base, "committed")))
    inbox = str(tmp_path / "in")
    change = lambda p, t: spark.createDataFrame([(p, "uncommitted", True, "Go", t)], CORPUS).write.mode("append").parquet(inbox)
    change("a", "first text")
    stream = spark.readStream.schema(CORPUS).parquet(inbox)
    follow(stream, store, str(tmp_path / "c")).awaitTermination()
    change("c", "third text")
    change("a", "second text")
    follow(stream, store, str(tmp_path / "c")).awaitTermination()
    dirty = spark.createDataFrame([("a",), ("c",)], DIRTY)
    rows = {r.path: [m.line for m in r.line_matches] for r in search(store.read(), "text", dirty).collect()}
    assert rows == {"a": ["second text"], "b": ["text"], "c": ["third text"]}


def test_a_linked_worktree_stays_warm(spark, repo, tmp_path_factory):
    """The second search of a linked tree finds nothing to do: its cache folder is no change."""
    other = tmp_path_factory.mktemp("linked") / "tree"
    sh(repo, "worktree", "add", "-q", str(other))
    git.register(spark)
    assert "keep.py" in cli.run(spark, str(other), "steady")
    state = git.repo_state(str(other))
    assert state.files == []
    store = Store(spark, f"file://{other}/{cli.CACHE}")
    assert st.refresh(spark, str(other), store, str(other / cli.CACHE / "lock"), state) == "none"


def test_a_publication_that_is_cut_off(spark, tmp_path, monkeypatch):
    """Up to the last step readers see the old manifest, never none."""
    store = Store(spark, f"file://{tmp_path}/s")
    row = lambda text: spark.createDataFrame([("p", "committed", False, "Go", text)], CORPUS)
    store.publish(Manifest(committed=store.write(row("old"), "committed")))
    new = store.write(row("new"), "committed")

    def cut(tmp, final):
        assert Store(spark, f"file://{tmp_path}/s").read().first().content == "old"
        raise OSError("cut off")

    monkeypatch.setattr(store, "_replace", cut)
    with pytest.raises(OSError):
        store.publish(Manifest(committed=new))
    monkeypatch.undo()
    assert store.read().first().content == "old"
    store.publish(Manifest(committed=new))
    assert store.read().first().content == "new"


def test_versions_go_after_the_next_publication(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    names = []
    for i in range(4):
        names.append(store.write(spark.createDataFrame([("p", "committed", False, "Go", f"text{i}")], CORPUS), "committed"))
        store.publish(Manifest(committed=names[-1]))
    left = {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()}
    assert left == {n + end for n in names[2:] for end in ("", "-grams")}
    assert store.manifest().sizes == {names[3]: [1, 5]} and store.index().files == 1


def test_one_failed_half_leaves_the_other(spark, repo, tmp_path_factory, monkeypatch):
    git.register(spark)
    root = tmp_path_factory.mktemp("half")
    store = Store(spark, f"file://{root}/s")
    (repo / "main.go").write_text("edit")
    monkeypatch.setattr(st, "worktree_files", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        st.refresh(spark, str(repo), store, str(root / "lock"))
    assert store.manifest().state == "" and {r.path for r in store.read().collect()} == {"main.go", "keep.py", ".gitignore"}
