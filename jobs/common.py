"""What the command lines share: arguments over a JSON file of defaults, a session that ends with the run, the log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def main(name: str, run: Callable, paths: tuple[str, ...]) -> None:
    """Runs ``run(spark, **settings)``; settings are the file's, paths of the command line take their places."""
    parser = argparse.ArgumentParser(prog=name, description=run.__doc__)
    parser.add_argument("--config", default=str(Path(__file__).with_name(f"{name}.json")), help="JSON file of settings")
    for path in paths:
        parser.add_argument(f"--{path}", help="a path that Spark reads or writes")
    given = vars(parser.parse_args())
    settings = json.loads(Path(given.pop("config")).read_text()) | {k: v for k, v in given.items() if v is not None}
    missing = [p for p in paths if not settings.get(p)]
    if missing:
        parser.error(f"no path for {', '.join(missing)}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, **settings)
    finally:
        spark.stop()
