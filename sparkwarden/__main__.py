"""``python -m sparkwarden scan FILE`` and ``python -m sparkwarden benchmark``."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from .endpoint import server
from .functions import columns
from .functions.pii import PiiOptions
from .functions.registry import FilterOptions
from .operators import adversarial, pdf
from .operators.ai import AiOptions
from .operators.moderate import GATES, ModerateOptions, moderate, samples, summarize
from .operators.providers import PROVIDERS
from .operators.report import text_report
from .sources import readers, sinks


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sparkwarden")
    commands = parser.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", help="moderate the records of a file")
    scan.add_argument("file")
    scan.add_argument("--languages", default="en", help="codes, or * for all")
    scan.add_argument("--pii", action="store_true")
    scan.add_argument("--kinds")
    scan.add_argument("--min-confidence", type=float, default=0.6)
    scan.add_argument("--no-filter", action="store_true")
    scan.add_argument("--literal", action="store_true", help="no look-alikes, nothing undone")
    scan.add_argument("--no-cross-check", action="store_true")
    scan.add_argument("--text-field", help="NDJSON property that holds the text")
    scan.add_argument("--id-field", help="NDJSON property that holds the id")
    scan.add_argument("--column")
    scan.add_argument("--id-column")
    scan.add_argument("--no-header", action="store_true")
    scan.add_argument("--delimiter")
    scan.add_argument("--out", help="NDJSON of flagged records")
    scan.add_argument("--all", action="store_true", help="write records that aren't flagged too")
    scan.add_argument("--pdf", help="write the summary as PDF")
    scan.add_argument("--json", action="store_true", help="the summary as JSON")
    scan.add_argument("--samples", type=int, default=20)
    scan.add_argument("--quiet", action="store_true", help="no progress on standard error")
    scan.add_argument("--fail-on-findings", "--fail-on-flagged", dest="fail", action="store_true", help="exit with 1 if anything was flagged")
    scan.add_argument("--ai", choices=sorted(PROVIDERS), help="ask a model of this provider")
    scan.add_argument("--ai-model")
    scan.add_argument("--ai-when", choices=GATES, default="matched")
    scan.add_argument("--max-calls", type=int, default=100, help="most records that a model is asked about")
    scan.add_argument("--concurrency", type=int, default=8, help="calls at once in each task")
    scan.add_argument("--unordered", action="store_true", help="write results as they come, not in order of the input")
    serve = commands.add_parser("serve", help="answer over HTTP")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8787)
    serve.add_argument("--ai", choices=sorted(PROVIDERS))
    bench = commands.add_parser("benchmark", help="score the filter against disguises")
    bench.add_argument("--compare", action="store_true", help="one line each: with look-alikes, and literally")
    bench.add_argument("--lang", action="append")
    bench.add_argument("--category", action="append")
    bench.add_argument("--json", action="store_true")
    bench.add_argument("--verbose", action="store_true")
    bench.add_argument("--list", action="store_true")
    bench.add_argument("--min-evasion", type=float)
    bench.add_argument("--min-precision", type=float)
    return parser


def _number(x: str | None) -> str | int | None:
    return int(x) if x is not None and x.isdigit() else x


def scan(spark: SparkSession, a: argparse.Namespace) -> int:
    began = time.time()
    options: dict = {}
    if a.file.lower().endswith((".csv", ".tsv")):
        options = {"column": _number(a.column), "id_column": _number(a.id_column), "header": not a.no_header} | ({"delimiter": a.delimiter} if a.delimiter else {})
    elif a.file.lower().endswith((".ndjson", ".jsonl")):
        options = {"text_field": a.text_field or a.column or "text", "id_field": a.id_field or a.id_column or "id"}
    languages = "*" if a.languages == "*" else tuple(x.strip() for x in a.languages.split(","))
    own = None if a.no_filter else FilterOptions(languages=languages, aggressive=not a.literal, cross_check=not a.no_cross_check)
    records = readers.records(spark, a.file, **options)
    found = PiiOptions(tuple(a.kinds.split(",")) if a.kinds else "*", a.min_confidence) if a.pii or a.kinds else None
    asked = AiOptions(provider=a.ai, model=a.ai_model) if a.ai else None
    if asked:
        asked.check_key()
    options = ModerateOptions(filter=own, pii=found, ai=asked, gate=a.ai_when, max_calls=a.max_calls if asked else None, concurrency=a.concurrency)
    results = moderate(records, options, id_column="id").persist()
    total = summarize(results).first().asDict(True)
    total |= {"elapsed_ms": round((time.time() - began) * 1000)}
    if not a.quiet:
        print(f"{total['processed']} records, {total['flagged']} flagged, {round(total['processed'] * 1000 / max(1, total['elapsed_ms']))}/s", file=sys.stderr)
    if a.out:
        out = sinks.flagged_output(results, a.all)
        sinks.write_ndjson(out if a.unordered else out.orderBy("index"), a.out, "overwrite")
    shown = [r.asDict(True) for r in samples(results, a.samples).collect()]
    if a.pdf:
        Path(a.pdf).write_bytes(pdf.document(text_report(total, shown)))
    print(json.dumps(total, ensure_ascii=False) if a.json else text_report(total, shown))
    return 1 if a.fail and total["flagged"] else 0


def benchmark(spark: SparkSession, a: argparse.Namespace) -> int:
    corpus = adversarial.attacks(spark, a.lang, a.category)
    if a.list:
        for r in corpus.collect():
            print(r["id"], r["category"], r["expect"], adversarial.visible(r["text"]))
        return 0
    if a.compare:
        literal = lambda text: columns.is_profane(text, FilterOptions(languages=("en", "de"), aggressive=False))
        print(adversarial.comparison({"look-alikes": adversarial.evaluate(corpus), "literal": adversarial.evaluate(corpus, literal)}))
        return 0
    done = adversarial.evaluate(corpus).persist()
    total = adversarial.score(done).first().asDict()
    print(json.dumps(total) if a.json else adversarial.report(done, verbose=a.verbose))
    low = a.min_evasion is not None and total["evasion_resistance"] < a.min_evasion or a.min_precision is not None and total["precision"] < a.min_precision
    return 1 if low else 0


def serve(spark: SparkSession, a: argparse.Namespace) -> int:
    asked = AiOptions(provider=a.ai) if a.ai else None
    if asked:
        asked.check_key()
    server(spark, a.host, a.port, asked).serve_forever()
    return 0


def main(argv: list[str] | None = None) -> int:
    a = _arguments().parse_args(argv)
    spark = SparkSession.builder.appName("sparkwarden").config("spark.ui.enabled", "false").getOrCreate()
    try:
        return {"scan": scan, "serve": serve, "benchmark": benchmark}[a.command](spark, a)
    except (ValueError, LookupError, TypeError) as why:
        print(f"sparkwarden: {why}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
