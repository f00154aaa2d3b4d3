"""``python -m framelode``: videos, search and plans of a store, and the registered queries."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from framelode import api
from framelode.config import Config
from framelode.plans import registry
from framelode.sources.store import Store


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="framelode", description=__doc__)
    parser.add_argument("--store", help="root of the store; spark.framelode.store without it")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("videos", help="the videos of the store")
    find = commands.add_parser("search", help="the best scenes of a video for a text")
    for name in ("--video-id", "--query"):
        find.add_argument(name, required=True)
    find.add_argument("--top-k", type=int)
    show = commands.add_parser("show-plan", help="a plan's cut list")
    show.add_argument("--plan-id", required=True)
    run = commands.add_parser("query", help="a registered query over a folder of tables; all names without one")
    run.add_argument("name", nargs="?")
    run.add_argument("--data")
    run.add_argument("--out", help="a folder for its rows as Parquet")
    asked = parser.parse_args(args)
    if asked.command == "query" and not asked.name:
        print("\n".join(sorted(registry.queries())))
        return
    spark = spark or SparkSession.builder.appName("framelode").getOrCreate()
    config = Config.of(spark)
    store = Store(spark, asked.store or config.store)
    if asked.command == "videos":
        rows = store.list_videos()
    elif asked.command == "search":
        queries = spark.createDataFrame([(0, asked.video_id, asked.query)], "query_id long, video_id string, query string")
        rows = api.searched(store, queries, asked.top_k or config.search_top).select("rank", "scene_index", "score", "match_type", "snippet", "start_cs", "end_cs").orderBy("rank")
    elif asked.command == "show-plan":
        rows = api.cut_list(store, asked.plan_id)
    else:
        rows = registry.queries()[asked.name](spark, asked.data)
        if asked.out:
            rows.write.parquet(asked.out)
            return
    rows.show(1000, truncate=60)


if __name__ == "__main__":
    main()
