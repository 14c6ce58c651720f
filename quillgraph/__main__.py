"""Command line: python -m quillgraph STORE COMMAND ..."""

from __future__ import annotations

import argparse

from .engine import Engine
from .schema import MODES
from .session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillgraph", description=__doc__)
    p.add_argument("store", help="folder of the versioned tables")
    p.add_argument("--master", help="Spark master, if not set elsewhere")
    c = p.add_subparsers(dest="command", required=True)
    x = c.add_parser("ingest", help="add or update files")
    x.add_argument("paths", nargs="+")
    x.add_argument("--retry-failed", action="store_true")
    x.add_argument("--wiki", action="store_true", help="write dirty pages afterwards")
    x = c.add_parser("remove", help="forget files at or below paths")
    x.add_argument("paths", nargs="+")
    for name in ("search", "ask", "compare"):
        x = c.add_parser(name)
        x.add_argument("question")
        x.add_argument("-k", type=int, default=8)
        if name == "compare":
            x.add_argument("--log", required=True, help="folder of the comparison log")
        else:
            x.add_argument("--mode", choices=MODES, default="rag")
    x = c.add_parser("wiki", help="write dirty pages")
    x.add_argument("--all", action="store_true")
    x = c.add_parser("analyze", help="ranks and communities")
    x.add_argument("--estimate", action="store_true")
    for name, what in (("reindex", "recompute vectors and postings"), ("status", "counts"), ("snapshot", "fingerprints"), ("reset", "forget everything")):
        c.add_parser(name, help=what)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    e = Engine(session("quillgraph", a.master), a.store)
    ask = lambda: e.spark.createDataFrame([(1, a.question)], "query_id long, question string")
    if a.command == "ingest":
        e.ingest(a.paths, retry_failed=a.retry_failed, build_wiki=a.wiki).show(1000, False)
    elif a.command == "remove":
        e.remove(a.paths).show(1000, False)
    elif a.command == "search":
        e.retrieve(ask(), a.mode, a.k).orderBy("ord").show(a.k * 8, 100)
    elif a.command == "ask":
        e.ask(ask(), a.mode, a.k).show(1, False, True)
    elif a.command == "compare":
        e.compare(ask(), a.log, a.k).select("mode", "answer").show(10, False)
    elif a.command == "wiki":
        print(e.build_wiki(a.all))
    elif a.command == "analyze":
        print(e.analyze(a.estimate))
    elif a.command == "reindex":
        print(e.reindex(), "chunks")
    elif a.command == "reset":
        e.store.wipe()
    else:
        getattr(e, a.command)().show(100, False)


if __name__ == "__main__":
    main()
