"""Command line: JSON in, JSON out. ``python -m netquarry.cli domains < names.json`` or ``... sessions --input ... --output ...``."""

from __future__ import annotations

import argparse
import json
import sys

#: Most bytes of a JSON input.
LIMIT = 64 * 1024


def document(raw: bytes):
    """A JSON input of at most LIMIT bytes without repeated keys."""
    if len(raw) > LIMIT:
        raise ValueError("the input is too large")

    def once(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("a key is repeated")
        return dict(pairs)

    return json.loads(raw, object_pairs_hook=once)


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("netquarry").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def domains(spark, told) -> list[dict]:
    """Features of a list of names, or of the list under "fqdns"; null where a name is invalid."""
    from .functions.domains import FEATURES, with_features

    names = told["fqdns"] if isinstance(told, dict) else told
    if not all(isinstance(n, str) for n in names):
        raise ValueError("names must be strings")
    rows = with_features(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, fqdn string"), "fqdn").orderBy("i").collect()
    return [{"fqdn": r["fqdn"], "canonical": r["canonical"]} | {f: r[f] for f in FEATURES} for r in rows]


def main(arguments: list[str] | None = None, stdin=None, stdout=None) -> int:
    parser = argparse.ArgumentParser(prog="netquarry")
    parser.add_argument("command", choices=["domains", "query", "list"])
    parser.add_argument("--name", help="the query to run")
    parser.add_argument("--tables", help="folder of Parquet tables")
    parser.add_argument("--output", help="folder that the query's rows are written to; it must not be there")
    a = parser.parse_args(arguments)
    stdin, stdout = stdin or sys.stdin.buffer, stdout or sys.stdout
    try:
        from .plans import registry

        if a.command == "list":
            out = sorted(registry.queries())
        elif a.command == "domains":
            out = domains(session(), document(stdin.read(LIMIT + 1)))
        else:
            df = registry.queries()[a.name](session(), a.tables)
            df.write.parquet(a.output)
            out = {"query": a.name, "output": a.output}
        print(json.dumps(out), file=stdout)
        return 0
    except Exception as e:  # whatever it is, the caller gets JSON and a code
        print(json.dumps({"error": f"{type(e).__name__}: {e}"[:500]}), file=stdout)
        return 1


if __name__ == "__main__":
    sys.exit(main())
