"""python -m orrery QUERY TABLES [OUT]: runs a registered query over a folder of tables.

Its rows are written to OUT as lines of comma-separated fields, or the first 20 are printed.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from orrery.plans.queries import queries
from orrery.sources.sinks import preview, write_delimited


def main(args: list[str]) -> int:
    known = queries()
    if len(args) not in (2, 3) or args[0] not in known:
        print(__doc__, "\nQueries:", " ".join(sorted(known)), file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName(f"orrery {args[0]}").getOrCreate()
    got = known[args[0]](spark, args[1])
    if len(args) == 3:
        write_delimited(got, args[2], sep=",")
    else:
        print("\n".join(preview(got)))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
