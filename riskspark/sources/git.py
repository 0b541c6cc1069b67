"""The commit log of a git repository as a Spark data source: spark.read.format("git_log").option("path", ...).load(). Paths are relative to the folder."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "sha string, author string, ts bigint, subject string, path string, insertions bigint, deletions bigint"


def git(root: str, *args: str, timeout: float = 180) -> tuple[int, bytes]:
    """Exit code and output; -1 on a timeout, -2 if git can't be run. Never asks anything."""
    env = os.environ | {"GIT_TERMINAL_PROMPT": "0", "LC_ALL": "C"}
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=timeout, env=env, stdin=subprocess.DEVNULL)
    except subprocess.TimeoutExpired:
        return -1, b""
    except OSError:
        return -2, b""
    return done.returncode, done.stdout


def is_repository(root: str) -> bool:
    return git(root, "rev-parse", "--is-inside-work-tree")[1].strip() == b"true"


def top(root: str) -> str:
    return git(root, "rev-parse", "--show-toplevel")[1].decode().strip()


def is_partial(root: str) -> bool:
    """Line counts would fetch every blob of a partial clone."""
    return any(git(root, "config", "--get", k)[1].strip() for k in ("remote.origin.promisor", "extensions.partialClone"))


def tracked(root: str) -> list[str]:
    return [p for p in git(root, "ls-files", "-z")[1].decode(errors="replace").split("\0") if p]


def parse(log: str) -> Iterator[tuple]:
    """Rows of SCHEMA from a log whose commits begin with \\x1e and whose fields end with \\x1f."""
    for entry in log.split("\x1e")[1:]:
        sha, name, email, ts, subject, rest = (entry.split("\x1f", 5) + [""] * 6)[:6]
        for line in rest.replace("\0", "\n").split("\n"):
            parts = line.split("\t")
            if len(parts) == 3:
                yield sha, name or email, int(ts), subject, parts[2], *(int(x) if x.isdigit() else 0 for x in parts[:2])
            elif line.strip():
                yield sha, name or email, int(ts), subject, line, 0, 0


def no_history(root: str) -> str | None:
    """Why there is no commit log, or None."""
    code, out = git(root, "rev-parse", "--is-inside-work-tree")
    if code == -2:
        return "git can't be run"
    if code == -1:
        return "git timed out"
    if code or out.strip() != b"true":
        return "not a repository"
    code, out = git(root, "rev-list", "--count", "--no-merges", "HEAD")
    return None if code == 0 and int(out) else "no commits"


def entries(root: str, *args: str) -> Iterator[str]:
    """The log's entries one by one, as git writes them; an error if git ends with one."""
    env = os.environ | {"GIT_TERMINAL_PROMPT": "0", "LC_ALL": "C"}
    with subprocess.Popen(["git", "-C", root, *args], stdout=subprocess.PIPE, stderr=subprocess.PIPE, stdin=subprocess.DEVNULL, env=env) as run:
        rest = b""
        while chunk := run.stdout.read(1 << 16):
            *whole, rest = (rest + chunk).split(b"\x1e")
            yield from (x.decode(errors="replace") for x in whole if x)
        if rest:
            yield rest.decode(errors="replace")
        said = run.stderr.read().decode(errors="replace").strip()
    if run.returncode:
        raise RuntimeError(f"git log failed: {said[-300:]}")


class _Range(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class _Reader(DataSourceReader):
    """A partition for each `each` commits, up to `max`; no rows where there is no history (no_history() says why)."""

    def __init__(self, options):
        self.root, self.days, self.most, self.each = options.get("path", "."), int(options.get("days", 730)), int(options.get("max", 20_000)), int(options.get("each", 2_000))

    def partitions(self):
        if no_history(self.root):
            return []
        code, out = git(self.root, "rev-list", "--count", "--no-merges", f"--since={self.days}.days", "HEAD")
        if code:
            raise RuntimeError("git can't count the commits")
        n = min(int(out), self.most)
        return [_Range(lo, min(self.each, n - lo)) for lo in range(0, n, self.each)]

    def read(self, partition):
        if partition is None:  # Spark's way to say that there are no partitions
            return
        names = "--name-only" if is_partial(self.root) else "--numstat"
        args = ["log", "--no-merges", "--no-renames", "--relative", "-z", f"--since={self.days}.days", f"--skip={partition.first}", f"--max-count={partition.count}", "--format=%x1e%H%x1f%an%x1f%ae%x1f%at%x1f%s%x1f"]
        for entry in entries(self.root, *args, names):
            yield from parse("\x1e" + entry)


class GitLog(DataSource):
    @classmethod
    def name(cls):
        return "git_log"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
