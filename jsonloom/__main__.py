"""Command line: ingest FOLDER STORE [prune], ask TABLES QUESTION, corpus TABLES QUESTIONS_FILE, reset STORE.

JSONLOOM_LOG sets the level of messages (WARNING).
"""

from __future__ import annotations

import logging
import os
import sys

from jsonloom.plans.ingest import ingest
from jsonloom.plans.planner import ask, corpus_questions
from jsonloom.session import get_spark
from jsonloom.sources.store import Store


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    logging.basicConfig(level=os.environ.get("JSONLOOM_LOG", "WARNING").upper(), format="%(asctime)s %(levelname)s %(name)s %(message)s")
    spark = get_spark()
    if args[0] == "ingest":
        print(ingest(spark, args[1], args[2], prune="prune" in args[3:]), "files")
    elif args[0] == "ask":
        ask(spark, args[1], " ".join(args[2:])).show(50, truncate=False)
    elif args[0] == "corpus":
        for q in corpus_questions(args[2]):
            print(q)
            ask(spark, args[1], q).show(10, truncate=False)
    elif args[0] == "reset":
        Store(spark, args[1]).reset()
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
