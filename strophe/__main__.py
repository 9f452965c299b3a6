"""Run a query over a folder of tables: python -m strophe QUERY --input FOLDER --output FOLDER."""

import argparse

from strophe.plans import catalog
from strophe.session import session


def main(args: list[str] | None = None) -> None:
    known = catalog.queries()
    p = argparse.ArgumentParser(prog="strophe", description="Run a query and write its result.")
    p.add_argument("query", choices=sorted(known))
    p.add_argument("--input", required=True, help="folder with one Parquet file or folder a table")
    p.add_argument("--output", required=True, help="folder for the result, which may exist")
    p.add_argument("--format", choices=("parquet", "json", "csv"), default="parquet")
    p.add_argument("--mode", choices=("append", "overwrite", "errorifexists"), default="errorifexists")
    p.add_argument("--master", default=None, help="Spark master; by default that of spark-submit")
    a = p.parse_args(args)
    spark = session("strophe", a.master)
    known[a.query](spark, a.input).write.format(a.format).mode(a.mode).save(a.output)


if __name__ == "__main__":
    main()
