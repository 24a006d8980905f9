"""Sources: every one yields files(skill_id, dir, path, content)."""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "skill_id string, dir string, path string, content binary"


def from_files(spark: SparkSession, files: Mapping[str, str | bytes], dir: str | None = None, skill_id: str = "skill") -> DataFrame:
    """An in-memory tree; strings are UTF-8 encoded."""
    rows = [(skill_id, dir, p, bytearray(c.encode("utf-8", "surrogatepass") if isinstance(c, str) else c)) for p, c in files.items()]
    return spark.createDataFrame(rows or [(skill_id, dir, None, None)], FILES)


def from_table(df: DataFrame) -> DataFrame:
    """Any table with the columns of FILES; text content is encoded."""
    content = F.encode("content", "UTF-8") if dict(df.dtypes)["content"] == "string" else F.col("content")
    folder = F.col("dir") if "dir" in df.columns else F.lit(None)
    return df.select(F.col("skill_id").cast("string").alias("skill_id"), folder.cast("string").alias("dir"), "path", content.alias("content"))


def list_tree(root: str) -> list[tuple[str, int]]:
    """(path, size) of the regular files below root; symlinks are skipped, dotfiles are not."""
    out, stack = [], [""]
    while stack:
        at = stack.pop()
        with os.scandir(os.path.join(root, at)) as entries:
            for e in entries:
                path = f"{at}/{e.name}" if at else e.name
                if e.is_dir(follow_symlinks=False):
                    stack.append(path)
                elif e.is_file(follow_symlinks=False):
                    out.append((path, e.stat(follow_symlinks=False).st_size))
    return sorted(out)


def inside(root: str, path: str) -> str:
    """The place of a path below root; one that leaves it is an error."""
    full = os.path.normpath(os.path.join(root, path))
    if os.path.isabs(path) or os.path.commonpath([os.path.abspath(root), os.path.abspath(full)]) != os.path.abspath(root):
        raise ValueError(f"path escapes the source root: {path}")
    return full


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for skill_id, folder, root in zip(pdf["skill_id"], pdf["dir"], pdf["root"]):
            paths = [p for p, _ in list_tree(root)] or [None]
            yield pd.DataFrame({"skill_id": skill_id, "dir": folder, "path": pd.Series(paths, dtype=object), "root": root})


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        content = []
        for root, path in zip(pdf["root"], pdf["path"]):
            if path is None:  # a folder without files
                content.append(None)
                continue
            with open(inside(root, path), "rb") as f:
                content.append(f.read())
        yield pd.DataFrame({"skill_id": pdf["skill_id"], "dir": pdf["dir"], "path": pdf["path"], "content": pd.Series(content, dtype=object)})


def from_dirs(spark: SparkSession, roots: Mapping[str, str]) -> DataFrame:
    """Folders by skill_id, on storage that all workers see; they are listed and their files read on the executors."""
    rows = [(k, os.path.basename(os.path.realpath(r)) or None, os.path.abspath(r)) for k, r in roots.items()]
    n = max(1, min(len(rows), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    listed = spark.createDataFrame(rows, "skill_id string, dir string, root string").repartition(n, "skill_id").mapInPandas(_list, "skill_id string, dir string, path string, root string")
    return listed.repartition("skill_id", "path").mapInPandas(_read, FILES)


def from_dir(spark: SparkSession, root: str) -> DataFrame:
    return from_dirs(spark, {os.path.basename(os.path.realpath(root)): root})
