"""Packages of a tree, told by their manifests: which package a file belongs to."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of manifests and the ecosystems they belong to.
MANIFESTS = {"Cargo.toml": "cargo", "go.mod": "go", "package.json": "npm", "pyproject.toml": "python", "setup.py": "python"}


def _package(name: str, content: str) -> tuple[str | None, list[str]]:
    """The package's name and the members of a workspace, as far as a manifest tells; what can't be read has none."""
    try:
        if name == "go.mod":
            m = re.search(r"^\s*module\s+\"?([^\s\"]+)", content, re.M)
            return (m and m[1]), []
        if name == "package.json":
            x = json.loads(content)
            w = x.get("workspaces") or []
            return x.get("name"), list(w.get("packages", []) if isinstance(w, dict) else w)
        if name == "setup.py":
            m = re.search(r"\bname\s*=\s*[\"']([^\"']+)", content)
            return (m and m[1]), []
        x = tomllib.loads(content)
        if name == "Cargo.toml":
            return x.get("package", {}).get("name"), list(x.get("workspace", {}).get("members", []))
        return x.get("project", {}).get("name") or x.get("tool", {}).get("poetry", {}).get("name"), []
    except (ValueError, TypeError, AttributeError):
        return None, []


def packages(sources: DataFrame) -> DataFrame:
    """(folder, ecosystem, package, members) of each manifest among sources (path, content); folder is '' for the root. Manifests without a package's name, such
    as those of a mere workspace, have a null package; rows without path or content are left out."""
    named = sources.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(F.col("name").isin(*MANIFESTS) & F.col("content").isNotNull())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            told = [_package(n, c) for n, c in zip(x["name"], x["content"])]
            yield pd.DataFrame({"folder": x["path"].str.rpartition("/")[0], "ecosystem": x["name"].map(MANIFESTS), "package": [t[0] for t in told], "members": [[str(m) for m in t[1]] for t in told]})

    return named.select("path", "name", "content").distinct().mapInPandas(run, "folder string, ecosystem string, package string, members array<string>")


def package_of(paths: DataFrame, known: DataFrame) -> DataFrame:
    """(path, ecosystem, package, module): the package in the nearest folder above a file, and the file's place below it; files above which no package
    stands are left out. Each path is joined by its folders, so nothing is compared with all packages."""
    parts = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    folders = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    each = paths.select("path").where(F.col("path").isNotNull()).distinct().select("path", F.explode(folders).alias("folder"))
    hits = each.join(known.where(F.col("package").isNotNull()).select("folder", "ecosystem", "package"), "folder")
    best = hits.groupBy("path", "ecosystem").agg(F.max(F.struct(F.length("folder").alias("n"), "folder", "package")).alias("x"))
    below = F.expr("substring(path, if(x.n = 0, 1, x.n + 2))")
    return best.select("path", "ecosystem", "x.package", below.alias("module"))
