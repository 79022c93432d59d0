"""Programs: convert a file, serve extracts of a store, keep a store current."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .operators import segments
from .server import PORT, serve
from .sources import folders
from .sources.files import convert, load_osm
from .streaming.replication import follow
from .streaming.updater import fetch_from, poll


def arguments(words: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="terrane", description=__doc__)
    sub = p.add_subparsers(dest="program", required=True)
    c = sub.add_parser("convert", help="read .pbf or .vex, write .pbf, .vex or .txt")
    c.add_argument("source")
    c.add_argument("target")
    s = sub.add_parser("serve", help="answer extracts of a store over HTTP")
    s.add_argument("store")
    s.add_argument("--load", metavar="FILE_OR_URL", help="fill the store from this first")
    s.add_argument("--keys", nargs="*", help="keep only tags with these keys")
    s.add_argument("--indexes", nargs="*", default=["index"], choices=list(segments.INDEXES), help="indexes that a store which is filled keeps: of ways by tile, of references by node")
    s.add_argument("--port", type=int, default=PORT)
    u = sub.add_parser("update", help="apply the diffs of a replication server, once a minute")
    u.add_argument("store")
    u.add_argument("replication", help="folder or URL that holds minute, hour and day")
    u.add_argument("--turns", type=int, help="stop after so many")
    u.add_argument("--checkpoint", help="folder of the stream's offsets, for a log-structured store (default: beside the store)")
    return p.parse_args(words)


def main(words: list[str] | None = None) -> None:
    a = arguments(words)
    spark = SparkSession.builder.appName(f"terrane {a.program}").getOrCreate()
    began = time.time()
    if a.program == "convert":
        convert(spark, a.source, a.target)
    elif a.program == "update":
        if folders.exists(spark, f"{a.store}/log"):
            follow(spark, a.store, a.replication, a.checkpoint or f"{a.store.rstrip('/')}-offsets", once=a.turns is not None).awaitTermination()
        else:
            poll(spark, a.store, fetch_from(a.replication), turns=a.turns)
    else:
        if a.load:
            segments.create(load_osm(spark, a.load, keys=a.keys), a.store, indexes=tuple(a.indexes))
        serve(spark, a.store, a.port).serve_forever()
    print(f"{time.time() - began:.1f} seconds")


if __name__ == "__main__":
    main()
