"""Commands:

python -m quillspark INPUT [--output FILE] [--format json|md]   requirement sentences of a text, or the report of an analysis
python -m quillspark search FOLDER QUERY [--top N]              the articles of a saved index that are nearest to a text
python -m quillspark corpus SOURCES RAW OUTPUT [--least N]      documents of saved pages as JSON lines, and their summary
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def _analysis(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="quillspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("input")
    parser.add_argument("--output")
    parser.add_argument("--format", choices=("json", "md"))
    parser.add_argument("--profile", default="ru")
    args = parser.parse_args(arguments)
    from quillspark.operators.report import analyse, markdown
    from quillspark.profiles import PROFILES
    from quillspark.session import local_session
    from quillspark.sources.io import read_analysis, read_text, summary_json

    kind = args.format or ("md" if (args.output or "").endswith(".md") else "json")
    if not Path(args.input).is_file():
        raise ValueError(f"there is no file {args.input}")
    spark = local_session(2)
    if args.input.endswith(".json"):
        analysis, kind = read_analysis(spark, args.input), "md"
    else:
        texts = read_text(spark, args.input)
        if not texts.first()["text"].strip():
            raise ValueError("the text is blank")
        analysis = analyse(texts, PROFILES[args.profile])
    out = markdown(analysis).first()["markdown"] if kind == "md" else summary_json(analysis).first()["value"] + "\n"
    if args.output:
        Path(args.output).write_text(out, encoding="utf-8")
    else:
        print(out, end="")
    return 0


def _search(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="quillspark search")
    parser.add_argument("folder")
    parser.add_argument("query")
    parser.add_argument("--top", type=int, default=5)
    parser.add_argument("--profile", default="ru")
    args = parser.parse_args(arguments)
    if args.top < 1:
        parser.error("--top must be positive")
    from quillspark.plans.search import search
    from quillspark.profiles import PROFILES
    from quillspark.session import local_session

    for r in search(local_session(2), args.folder, args.query, args.top, PROFILES[args.profile]).collect():  # --top rows
        row = r.asDict()
        title = " ".join(str(row[c]) for c in ("document_title", "article_number", "article_title") if row.get(c)) or row["article_id"]
        print(f"{r['rank']}. {title}\n   {r['similarity']:.4f}\n   {r['preview']}\n")
    return 0


def _corpus(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="quillspark corpus")
    parser.add_argument("sources")
    parser.add_argument("raw")
    parser.add_argument("output")
    parser.add_argument("--profile", default="ru")
    parser.add_argument("--least", type=int, default=50_000, help="words that the corpus should have")
    parser.add_argument("--least-document", type=int, default=1000, help="words that each document must have")
    args = parser.parse_args(arguments)
    from pyspark.sql import functions as F

    from quillspark.profiles import PROFILES
    from quillspark.session import local_session
    from quillspark.sources import io

    spark = local_session(2)
    pages, meta = io.read_snapshots(spark, args.raw)
    built = io.build_documents(io.read_sources(spark, args.sources), pages, meta, PROFILES[args.profile], args.least_document)
    path = f"{args.output.rstrip('/')}/documents.jsonl"
    io.write_jsonl(built, path)
    found = io.read_documents(spark, path)
    about = F.sort_array(F.collect_list(F.struct("id", "title", "topic", "url", "fetched_at_utc", "sha256", "word_count")))
    summary = found.agg(F.count(F.lit(1)).alias("document_count"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("total_words"), F.lit(args.least).alias("minimum_words_required"), about.alias("documents"))
    io.write_json(summary, f"{args.output.rstrip('/')}/corpus_summary.json")
    total = found.agg(F.sum("word_count")).first()[0] or 0
    print(f"{found.count()} documents, {total} words")
    if total < args.least:
        print(f"the corpus has fewer than {args.least} words", file=sys.stderr)
        return 1
    return 0


def main(arguments: list[str] | None = None) -> int:
    arguments = sys.argv[1:] if arguments is None else arguments
    commands = {"search": _search, "corpus": _corpus}
    run, rest = (commands[arguments[0]], arguments[1:]) if arguments and arguments[0] in commands else (_analysis, arguments)
    try:
        return run(rest)
    except Exception as error:  # the command line reports and ends
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
