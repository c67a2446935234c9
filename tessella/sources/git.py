"""Change history from a Git repository, as a batch data source and as tables."""

from __future__ import annotations

import re
import subprocess
import threading
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "repo string, seq int, id string, parents array<string>, ts long, path string, previous_path string, kind string, content_changed boolean, added long, deleted long, coverage string"
KINDS = frozenset("AMDRT")


def run_git(root: str, *arguments: str, seconds: float = 30, most: int = 64 << 20) -> bytes:
    """A Git command's output, within limits of time and size."""
    done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, timeout=seconds, check=False)
    if done.returncode:
        raise RuntimeError(done.stderr.decode(errors="replace").strip() or f"git {arguments[0]} failed")
    if len(done.stdout) > most:
        raise RuntimeError(f"git {arguments[0]} wrote more than {most} bytes")
    return done.stdout


def parse_changes(raw: bytes) -> list[tuple[str, str | None, str, bool]]:
    """(path, previous path, kind, whether the content changed) of NUL-separated raw differences."""
    return parse_fields(raw.decode(errors="surrogateescape").split("\0"))


def parse_fields(fields: list[str]) -> list[tuple[str, str | None, str, bool]]:
    out, i = [], 0
    while i < len(fields) and fields[i].startswith(":"):
        _, _, before, after, status = fields[i].split(" ")
        kind = status[0]
        if kind not in KINDS:
            raise ValueError(f"a change of kind {status}")
        renamed = kind == "R"
        path, old = (fields[i + 2], fields[i + 1]) if renamed else (fields[i + 1], None)
        out.append((path, old, kind, before != after))
        i += 3 if renamed else 2
    return out


def nul_fields(stream) -> Iterator[str]:
    """The fields of a stream that ends each with a NUL, as they come."""
    held = b""
    while chunk := stream.read1(1 << 16):
        *whole, held = (held + chunk).split(b"\0")
        for x in whole:
            yield x.decode(errors="surrogateescape")
    if held:
        yield held.decode(errors="surrogateescape")


@contextmanager
def git_process(root: str, *arguments: str, lines: Iterable[str] = ()) -> Iterator[BinaryIO]:
    """The output of one long-lived Git process that is fed lines by a thread, so neither side waits for the other's whole text."""
    process = subprocess.Popen(["git", "--no-optional-locks", "-C", root, *arguments], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE)

    def feed() -> None:
        with suppress(BrokenPipeError, ValueError):
            for line in lines:
                process.stdin.write(line.encode(errors="surrogateescape") + b"\n")
            process.stdin.close()

    writer = threading.Thread(target=feed, daemon=True)
    writer.start()
    try:
        yield process.stdout
        process.stdout.read()
        writer.join()
        if process.wait():
            raise RuntimeError(process.stderr.read().decode(errors="replace").strip() or f"git {arguments[0]} failed")
    finally:
        process.kill()
        for pipe in (process.stdout, process.stderr):
            pipe.close()
        process.wait()


def listed_commits(root: str, window: int) -> tuple[list[tuple[int, str, list[str], int]], str]:
    """(seq, id, parents, time) of the newest commits, first parents only, and what ends them.

    One commit more than the window is asked for: if it is there, the window ends the coverage, else the root or a
    shallow clone does."""
    listed = [x.split("\t") for x in run_git(root, "log", "--first-parent", f"--max-count={window + 1}", "--format=%H%x09%P%x09%ct", "HEAD").decode().splitlines()]
    shallow = run_git(root, "rev-parse", "--is-shallow-repository").decode().strip() == "true"
    coverage = "window" if len(listed) > window else "shallow" if shallow else "root"
    return [(seq, c, p.split(), int(ts)) for seq, (c, p, ts) in enumerate(listed[:window])], coverage


def _by_commit(fields: Iterator[str], ids: set[str]) -> Iterator[tuple[str, list[str]]]:
    """Fields of one commit after the other: each begins with its id."""
    now, held = None, []
    for x in fields:
        if x in ids:
            if now:
                yield now, held
            now, held = x, []
        else:
            held.append(x)
    if now:
        yield now, held


def read_commits(root: str, commits: list[tuple[int, str, list[str], int]], coverage: str) -> Iterator[tuple]:
    """Rows of SCHEMA for some commits: a row per change, or one with nulls for a commit without any. Two Git processes answer for all of them."""
    asked = [" ".join((c, *parents[:1])) for _, c, parents, _ in commits]
    ids = {c for _, c, _, _ in commits}
    how = ("diff-tree", "--stdin", "--always", "-r", "--root", "-z")
    with git_process(root, *how, "-M50%", "--raw", "--no-abbrev", lines=asked) as raw, git_process(root, *how, "--no-renames", "--numstat", lines=asked) as stat:
        for (seq, commit, parents, ts), (_, fields), (_, lines) in zip(commits, _by_commit(nul_fields(raw), ids), _by_commit(nul_fields(stat), ids)):
            counts = {}
            for line in lines:
                if line.count("\t") == 2:
                    a, d, path = line.split("\t")
                    counts[path] = (int(a) if a != "-" else 0, int(d) if d != "-" else 0)
            base = (root, seq, commit, parents, ts)
            changes = parse_fields(fields)
            for path, old, kind, changed in changes:
                yield (*base, path, old, kind, changed, *counts.get(path, (0, 0)), coverage)
            if not changes:
                yield (*base, None, None, None, None, None, None, coverage)


def read_history(root: str, window: int = 500) -> Iterator[tuple]:
    """Rows of SCHEMA; the newest commit is seq 0."""
    yield from read_commits(root, *listed_commits(root, window))


#: Commits, or revisions, of one partition.
RANGE = 100


class RangePartition(InputPartition):
    """Some commits or revisions of one repository."""

    def __init__(self, root: str, rows: list, coverage: str = ""):
        super().__init__((root, rows[0] if rows else None))
        self.root, self.rows, self.coverage = root, rows, coverage


def _ranges(root: str, rows: list, coverage: str = "") -> list[InputPartition]:
    return [RangePartition(root, rows[i : i + RANGE], coverage) for i in range(0, len(rows), RANGE)]


class HistoryReader(DataSourceReader):
    def __init__(self, roots: list[str], window: int):
        self.roots, self.window = roots, window

    def partitions(self) -> list[InputPartition]:
        return [p for root in self.roots for p in _ranges(root, *listed_commits(root, self.window))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from read_commits(partition.root, partition.rows, partition.coverage)


class HistorySource(DataSource):
    """spark.read.format("git_history").option("roots", "a,b").option("window", 500): a partition per hundred commits of a repository."""

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return HistoryReader([r for r in self.options["roots"].split(",") if r], int(self.options.get("window", "500")))


def history(spark: SparkSession, roots: list[str], window: int = 500) -> DataFrame:
    spark.dataSource.register(HistorySource)
    return spark.read.format("git_history").option("roots", ",".join(roots)).option("window", str(window)).load()


def commits(changes: DataFrame) -> DataFrame:
    return changes.select("repo", "seq", "id", "parents", "ts", "coverage").distinct()


def tracked_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths that Git tracks or would, of the work tree."""
    listed = run_git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard").decode(errors="surrogateescape").split("\0")
    return spark.createDataFrame([(root, p) for p in sorted({x for x in listed if x})], "repo string, path string")


SNAPSHOT = "repo string, seq int, revision string, path string, oid string, size long, lines long, test boolean, index boolean, reexport boolean"
# What counts as authored source in a snapshot.
SNAPSHOT_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
SNAPSHOT_EXCLUDED = frozenset("node_modules vendor dist build coverage artifacts runtime .venv".split())
_TEST = re.compile(r"(^|/)(tests?|__tests__)/|\.(test|spec)\.")
_REEXPORT = re.compile(r"\bexport\b[^;]*\bfrom\s*['\"]")
#: Blobs whose figures a partition remembers, so that a file that many revisions share is read once.
REMEMBERED = 200_000


def authored_source(path: str) -> bool:
    parts = path.split("/")
    return parts[-1].endswith(SNAPSHOT_ENDINGS) and not parts[-1].endswith(".d.ts") and not SNAPSHOT_EXCLUDED.intersection(parts)


class Objects:
    """Objects of a repository, asked of one long-lived process."""

    def __init__(self, root: str):
        self.process = subprocess.Popen(["git", "--no-optional-locks", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)

    def get(self, name: str) -> tuple[str, bytes]:
        self.process.stdin.write(name.encode() + b"\n")
        self.process.stdin.flush()
        head = self.process.stdout.readline().decode(errors="replace").split()
        if len(head) != 3:
            raise RuntimeError(f"git has no object {name}")
        data = self.process.stdout.read(int(head[2]) + 1)
        return head[0], data[:-1]

    def close(self) -> None:
        self.process.stdin.close()
        self.process.stdout.close()
        self.process.wait()


def tree_entries(data: bytes, width: int) -> Iterator[tuple[str, str, str]]:
    """(mode, name, object) of a tree object whose names of objects have `width` bytes."""
    at = 0
    while at < len(data):
        space, nul = data.index(b" ", at), data.index(b"\0", at)
        yield data[at:space].decode(), data[space + 1 : nul].decode(errors="surrogateescape"), data[nul + 1 : nul + 1 + width].hex()
        at = nul + 1 + width


def blob_facts(data: bytes, path: str) -> tuple[int, bool]:
    """Lines that aren't blank, and whether the text hands on another file's names."""
    text = data.decode(errors="replace")
    return sum(1 for line in text.splitlines() if line.strip()), bool(_REEXPORT.search(text))


def read_snapshots(root: str, revisions: list[tuple[int, str]]) -> Iterator[tuple]:
    """Rows of SNAPSHOT: the authored files of each revision; folders are walked by their tree objects, blobs are read once."""
    objects, facts = Objects(root), {}
    try:
        for seq, revision in revisions:
            oid, data = objects.get(f"{revision}^{{tree}}")
            pending = [("", oid, data)]
            while pending:
                folder, oid, data = pending.pop()
                for mode, name, child in tree_entries(data, len(oid) // 2):
                    path = folder + name
                    if mode == "40000":
                        if name not in SNAPSHOT_EXCLUDED:
                            pending.append((path + "/", *objects.get(child)))
                    elif mode.startswith("100") and authored_source(path):
                        if child not in facts:
                            if len(facts) >= REMEMBERED:
                                facts.clear()
                            _, blob = objects.get(child)
                            facts[child] = (len(blob), *blob_facts(blob, path))
                        size, lines, reexport = facts[child]
                        stem = name.rpartition(".")[0]
                        yield root, seq, revision, path, child, size, lines, bool(_TEST.search(path)), stem == "index", reexport
    finally:
        objects.close()


class SnapshotReader(DataSourceReader):
    def __init__(self, roots: list[str], window: int, every: int):
        self.roots, self.window, self.every = roots, window, every

    def partitions(self) -> list[InputPartition]:
        return [p for root in self.roots for p in _ranges(root, [(seq, c) for seq, c, _, _ in listed_commits(root, self.window)[0]][:: self.every])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from read_snapshots(partition.root, partition.rows)


class SnapshotSource(DataSource):
    """spark.read.format("git_snapshots").option("roots", "a,b").option("window", 500).option("every", 1): a partition per hundred revisions."""

    @classmethod
    def name(cls) -> str:
        return "git_snapshots"

    def schema(self) -> str:
        return SNAPSHOT

    def reader(self, schema) -> DataSourceReader:
        return SnapshotReader([r for r in self.options["roots"].split(",") if r], int(self.options.get("window", "500")), int(self.options.get("every", "1")))


def snapshots(spark: SparkSession, roots: list[str], window: int = 500, every: int = 1) -> DataFrame:
    """Authored files of every revision, or every so many, newest first."""
    spark.dataSource.register(SnapshotSource)
    return spark.read.format("git_snapshots").option("roots", ",".join(roots)).option("window", str(window)).option("every", str(every)).load()
