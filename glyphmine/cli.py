"""Command line: ``python -m glyphmine.cli index|count|locate|regex|files|dfa|fm ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from glyphmine.functions import automata, show
from glyphmine.operators import global_index, index, match, search
from glyphmine.sources import corpus, formats, store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glyphmine")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("index", help="build an index of a file or folder")
    x.add_argument("path")
    x.add_argument("out")
    x.add_argument("--max-size", type=int, default=0, help="bytes of each file")
    x.add_argument("--no-filter-binary", action="store_true")
    x.add_argument("--reversed", action="store_true", help="index texts backwards")
    x.add_argument("--check", action="store_true", help="check the written index against its texts")
    x.add_argument("--whole", action="store_true", help="also the suffix array and BWT of all files as one text, in OUT/whole")
    x.add_argument("--keep", action="store_true", help="leave an index that is there already as it is")
    for name in ("count", "locate", "regex"):
        x = sub.add_parser(name)
        x.add_argument("path")
        x.add_argument("pattern")
        x.add_argument("--max-length", type=int, default=0, help="characters of a match; 0 for any")
        x.add_argument("--show", type=int, default=50, help="rows to print; the number of all is printed as well")
        x.add_argument("--context", type=int, default=20)
    x = sub.add_parser("dfa", help="show the automaton of a pattern")
    x.add_argument("pattern")
    x.add_argument("--dot", action="store_true", help="as a DOT picture")
    x = sub.add_parser("fm", help="write the rank map of a BWT file")
    x.add_argument("bwt")
    x.add_argument("out")
    x.add_argument("--little-endian", action="store_true")
    x = sub.add_parser("files", help="write an index's binary files")
    x.add_argument("index")
    x.add_argument("out")
    x.add_argument("--little-endian", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "dfa":
        d = automata.compile_dfa(a.pattern)
        print(d.dot() if a.dot else "\n".join(f"{s} -{show.byte(lo)}{'..' + show.byte(hi) if hi > lo else ''}-> {t}{' (accepts)' if f else ''}" for s, lo, hi, t, f in d.transitions()))
        return
    if a.command == "fm":
        with open(a.bwt, "rb") as f:
            bwt, eof = formats.read_bwt_file(f.read(), not a.little_endian)
        with open(a.out, "wb") as f:
            f.write(formats.fm_file(formats.psi_of(bwt, eof), not a.little_endian))
        return
    spark = spark or SparkSession.builder.appName("glyphmine").getOrCreate()
    if a.command == "index":
        if a.keep and store.exists(spark, a.out):
            print("the index is there")
            return
        docs = corpus.read_files(spark, a.path, a.max_size, not a.no_filter_binary)
        with show.timed("index"):
            store.save(docs, a.out, text_col="data", orientation="reversed" if a.reversed else "forward")
        if a.whole:
            with show.timed("index of the whole"):
                global_index.save(docs.select("doc_id", "data"), f"{a.out}/whole", text_col="data")
        if a.check:
            built = store.Store(spark, a.out).index()
            wrong = index.is_sorted(built).where("not sorted").count()
            print("the index is in order" if not wrong else f"{wrong} documents are out of order")
    elif a.command == "files":
        formats.files(store.Store(spark, a.index).index(), not a.little_endian).write.mode("overwrite").parquet(a.out)
    else:
        docs = corpus.read_files(spark, a.path)
        if a.command == "count":
            out = search.count(docs, a.pattern)
        elif a.command == "locate":
            out = search.locate(docs, a.pattern, a.context)
        else:
            out = match.regex_matches(docs, a.pattern, a.max_length)
        out = out.persist()
        out.show(a.show, truncate=False)
        print(f"{out.count()} rows")


if __name__ == "__main__":
    main()
