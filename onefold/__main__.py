"""python -m onefold --inputs FOLDER --out FOLDER [--config FILE] [--threshold 0.6]"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from onefold.model import REVIEW_THRESHOLD
from onefold.plans import batch


def main(arguments: list[str] | None = None) -> int:
    """Errors of single people go to standard error and spoil nothing else, so the exit code is 0."""
    parser = argparse.ArgumentParser(prog="onefold", description=__doc__)
    parser.add_argument("--inputs", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--config")
    parser.add_argument("--threshold", type=float, default=REVIEW_THRESHOLD)
    given = parser.parse_args(arguments)
    config = None
    if given.config:
        with open(given.config, encoding="utf-8") as file:
            config = json.load(file)
    found = batch.run(SparkSession.builder.appName("onefold").getOrCreate(), given.inputs, config, threshold=given.threshold)
    batch.save(found, given.out)
    for row in found["errors"].toLocalIterator():
        print(f"{row.candidate_id}: {row.error}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
