"""Command line: questions to a knowledge base in a folder of Parquet tables.

    python -m cairnbase FOLDER stats|jobs|resync|library|wiki|lint|audit|collisions|disambiguations|relabels|duplicates
    python -m cairnbase FOLDER search|keyword QUERY
    python -m cairnbase FOLDER outline|source|entity|chapter|related ID
    python -m cairnbase FOLDER ingest INBOX
"""

from __future__ import annotations

import sys

from .plans.base import KnowledgeBase
from .session import build_session
from .sources.files import scan_folder, upsert_files

PLAIN = ("stats", "jobs", "resync", "library", "wiki", "lint", "audit", "collisions", "disambiguations", "relabels", "duplicates")
BY_ID = ("outline", "source", "entity", "chapter", "related")


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    folder, command, *rest = args
    spark = build_session("cairnbase")
    base = KnowledgeBase.load(spark, folder)
    if command in PLAIN:
        getattr(base, command)().show(100, False)
    elif command in BY_ID and rest:
        getattr(base, command)(int(rest[0])).show(100, False)
    elif command in ("search", "keyword") and rest:
        base.search(" ".join(rest), mode="keyword" if command == "keyword" else "hybrid").show(20, 100)
    elif command == "ingest" and rest:
        new = scan_folder(spark, rest[0])
        if not new.limit(1).count():
            print("the folder is empty")
            return 1
        out = upsert_files(base["files"].select(*new.columns), new)
        out.write.mode("overwrite").parquet(f"{folder}/files-new.parquet")
        spark.read.parquet(f"{folder}/files-new.parquet").write.mode("overwrite").parquet(f"{folder}/files.parquet")
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
