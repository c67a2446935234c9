"""Trees of revisions and long histories, each read by a few long-lived Git processes."""

import subprocess

import pytest

from tessella.operators.history import snapshot_summary
from tessella.sources import git


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("snapshots")

    def run(*a):
        return subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True).stdout.decode()

    run("init", "-q", "-b", "main")
    for folder in ("src/deep", "tests", "dist"):
        (root / folder).mkdir(parents=True)
    for i in range(6):
        (root / f"src/deep/f{i}.ts").write_text("line\n\n" * (i * 9))
        (root / "src/index.ts").write_text("export { a }\n  from './deep/f0';\n" + "x\n" * i)
        (root / "tests/a.ts").write_text("test")
        (root / "dist/out.js").write_text("no")
        (root / "types.d.ts").write_text("no")
        (root / "läng.tsx").write_bytes(b"\xff\n \nok")
        run("add", ".")
        run("commit", "-qm", f"number {i}")
    run("checkout", "-q", "-b", "side", "HEAD~2")
    (root / "side.js").write_text("1\n2\n")
    run("add", ".")
    run("commit", "-qm", "side")
    run("checkout", "-q", "main")
    run("merge", "-q", "--no-ff", "-m", "merged", "side")
    return str(root), run


def test_files_of_every_revision(spark, repository):
    root, run = repository
    found = git.snapshots(spark, [root])
    got = {(r["revision"], r["path"], r["oid"], r["size"]) for r in found.collect()}
    want = set()
    for revision in run("rev-list", "--first-parent", "HEAD").split():
        for line in run("ls-tree", "-r", "-l", "-z", revision).split("\0"):
            if line:
                head, path = line.split("\t")
                if git.authored_source(path):
                    want.add((revision, path, head.split()[2], int(head.split()[3])))
    assert got == want and len({r for r, *_ in want}) == 7
    newest = snapshot_summary(found).where("seq = 0").first().asDict()
    assert {k: newest[k] for k in ("files", "production_files", "test_files", "index_files", "reexporting_index_files", "directories", "ts_files", "tiny_files", "median_lines")} == {
        "files": 10, "production_files": 9, "test_files": 1, "index_files": 1, "reexporting_index_files": 1, "directories": 3, "ts_files": 8, "tiny_files": 6, "median_lines": 9.0,
    }
    assert newest["production_nonempty_lines"] == 9 * (1 + 2 + 3 + 4 + 5) + 7 + 2 + 2
    assert git.snapshots(spark, [root], every=3).select("seq").distinct().count() == 3


def test_ranges_give_what_the_whole_gives(repository):
    root, run = repository
    whole = list(git.read_history(root))
    commits, coverage = git.listed_commits(root, 500)
    assert whole == [row for one in commits for row in git.read_commits(root, [one], coverage)]
    assert [r[5] for r in whole if r[1] == 0] == ["side.js"] and len({r[2] for r in whole}) == 7
    assert {(r[5], r[9]) for r in whole if r[1] == 1} == {("src/deep/f5.ts", 90), ("src/index.ts", 1)}


def test_errors_are_told(repository):
    root, _ = repository
    with pytest.raises(RuntimeError):
        list(git.read_snapshots(root, [(0, "no-such-revision")]))
    with pytest.raises(RuntimeError):
        with git.git_process(root, "no-such-command") as out:
            out.read()
