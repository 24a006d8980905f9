"""python -m tomewise FOLDER [--json]: exit code 0 if the skill is ok, 1 if not, 2 for wrong use."""

from __future__ import annotations

import os
import sys

USAGE = "Usage: python -m tomewise FOLDER [--json]"


def run(argv: list[str], out=print, err=lambda s: print(s, file=sys.stderr), color: bool = False) -> int:
    """Options count in the order in which they stand; wrong use shows what is wrong, and the usage."""
    paths, wrong = [], None
    for arg in argv:
        if arg in ("-h", "--help"):
            out(USAGE)
            return 0
        if arg.startswith("-") and arg != "--json":
            wrong = f"unknown option '{arg}'"
            break
        if arg != "--json":
            paths.append(arg)
    if not wrong and len(paths) != 1:
        wrong = "expected at most one folder path" if paths else "missing folder path"
    if wrong:
        err(f"tomewise: {wrong}")
        err(USAGE)
        return 2
    if not os.path.exists(paths[0]):
        err(f"tomewise: no such file or directory: '{paths[0]}'")
        return 2
    if not os.path.isfile(os.path.join(paths[0], "SKILL.md")):
        err(f"tomewise: no SKILL.md in '{paths[0]}' — not a skill folder")
        return 2
    from pyspark.sql import SparkSession

    from .plans import render
    from .plans.analyze import analyze
    from .sources.trees import from_dir

    spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    try:
        row = analyze(from_dir(spark, paths[0])).first()
    except Exception as error:  # of the executors, too: what fails while reading is told, not thrown
        err(f"tomewise: {str(error).splitlines()[0]}")
        return 2
    out(render.to_json(row) if "--json" in argv else render.to_text(row, color))
    return 0 if row["ok"] else 1


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:], color=sys.stdout.isatty() and "NO_COLOR" not in os.environ))
