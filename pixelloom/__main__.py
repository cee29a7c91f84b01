"""python -m pixelloom list | convert SOURCE FOLDER: the codecs, or images of SOURCE (a path or glob) as PNGs in FOLDER."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession


def main(args: list[str]) -> int:
    from pixelloom.operators.decode import REGISTRY, decode
    from pixelloom.sources import images

    if args[:1] == ["list"] and len(args) == 1:
        print("\n".join(REGISTRY.names()))
        return 0
    if args[:1] != ["convert"] or len(args) != 3:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("pixelloom").getOrCreate()
    failed = 0
    for r in images.save_pngs(decode(images.read(spark, args[1])), args[2]).toLocalIterator():
        print(r["path"], "->", r["saved"] if r["ok"] else "no image")
        failed += not r["ok"]
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
