"""``python -m skein QUERY DATA_DIR OUT_DIR``: run a query and write its result; without arguments list the queries."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from skein.queries import QUERIES


def main(args: list[str]) -> int:
    """Exit code 0, or 2 for a wrong call."""
    if len(args) != 3 or args[0] not in QUERIES:
        print("\n".join(sorted(QUERIES)))
        return 0 if not args else 2
    spark = SparkSession.builder.getOrCreate()
    QUERIES[args[0]](spark, args[1]).write.mode("overwrite").parquet(args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
