"""Source trees: committed trees through git, working folders through the file system."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _git(repo: str, *args: str, data: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], input=data, capture_output=True, check=True).stdout


def tree_entries(repo: str, rev: str) -> list[tuple[str, str]]:
    """(path, blob id) of the files of a tree, without links and submodules, by path."""
    out = []
    for line in _git(repo, "ls-tree", "-r", "-z", rev).split(b"\0"):
        if line:
            meta, path = line.split(b"\t", 1)
            mode, kind, oid = meta.split()
            if kind == b"blob" and mode != b"120000":
                out.append((path.decode("utf-8", "replace"), oid.decode()))
    return sorted(out)


@dataclass
class _Slice(InputPartition):
    index: int
    of: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.rev, self.parts = options["path"], options.get("rev", "HEAD"), int(options.get("partitions", "8"))

    def partitions(self) -> list[InputPartition]:
        return [_Slice(i, self.parts) for i in range(self.parts)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        mine = [(p, o) for p, o in tree_entries(self.repo, self.rev) if crc32(p.encode()) % partition.of == partition.index]
        if not mine:
            return
        raw = _git(self.repo, "cat-file", "--batch", data="\n".join(o for _, o in mine).encode())
        at = 0
        for path, oid in mine:
            end = raw.index(b"\n", at)
            size = int(raw[at:end].split()[2])
            yield oid, path, raw[end + 1 : end + 1 + size]
            at = end + 2 + size


class GitTree(DataSource):
    """spark.read.format("git_tree").option("rev", "HEAD").load(repository): (blob_oid, path, content). All executors must see the repository."""

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return "blob_oid string, path string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_tree(spark: SparkSession, repo: str, rev: str = "HEAD", partitions: int = 8) -> DataFrame:
    spark.dataSource.register(GitTree)
    return spark.read.format("git_tree").option("rev", rev).option("partitions", partitions).load(repo)


def blob_id(content) -> F.Column:
    """git's id of a content."""
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), content))


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """(blob_oid, path, content) of a working folder, without .git."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit(root.rstrip("/").removeprefix("file:") + "/")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^/+", "/")
    rel = F.substring(path, F.length(base) + 1, F.length(path))
    return files.select(blob_id(F.col("content")).alias("blob_oid"), rel.alias("path"), "content").where(~F.col("path").rlike(r"(^|/)\.git/"))


def manifest(tree: DataFrame) -> DataFrame:
    return tree.select("path", "blob_oid")


def commit_files(repo: str, revs: str) -> list[tuple[str, int, str]]:
    """(commit, number of parents, path) of the commits in a range of revisions; feed this to coupling()."""
    out = []
    for block in _git(repo, "log", "--format=%x01%H %P", "--name-only", "-z", "--no-renames", revs).decode("utf-8", "replace").split("\x01")[1:]:
        head, _, rest = block.partition("\0")
        ids = head.split()
        out += [(ids[0], len(ids) - 1, p.strip("\n")) for p in rest.split("\0") if p.strip("\n")]
    return out


def merge_base(repo: str, a: str, b: str) -> str:
    return _git(repo, "merge-base", a, b).decode().strip()


def blame(repo: str, rev: str, path: str) -> list[tuple[str, int, str, str, int]]:
    """(file, line, commit, author, author_time) of each line."""
    out, commit, author, when = [], "", {}, {}
    line = 0
    for x in _git(repo, "blame", "--line-porcelain", rev, "--", path).decode("utf-8", "replace").split("\n"):
        if x.startswith("\t"):
            out.append((path, line, commit, author[commit], when[commit]))
        elif x.startswith("author "):
            author[commit] = x[7:]
        elif x.startswith("author-time "):
            when[commit] = int(x[12:])
        else:
            p = x.split()
            if len(p) >= 3 and len(p[0]) == 40:
                commit, line = p[0], int(p[2])
    return out


def uncovered_units(sources: DataFrame, compile_db: DataFrame) -> DataFrame:
    """(path): translation units of C++ that a compile database (file) doesn't cover; the database is complete if there are none."""
    units = sources.where(F.col("path").rlike(r"\.(cc|cpp|cxx)$")).select("path").distinct()
    db = compile_db.select(F.col("file").alias("file")).distinct()
    ends = units.join(db, F.element_at(F.split("file", "/"), -1) == F.element_at(F.split("path", "/"), -1), "left")
    covered = ends.where((F.col("file") == F.col("path")) | F.col("file").endswith(F.concat(F.lit("/"), F.col("path")))).select("path").distinct()
    return units.join(covered, "path", "left_anti")
