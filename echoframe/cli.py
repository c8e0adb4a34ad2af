"""Command line: python -m echoframe.cli --path DIR [options]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from echoframe.config import ScanConfig, load_config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="echoframe", description="Finds duplicated functions in a source tree.")
    p.add_argument("--path", help="folder to scan")
    p.add_argument("--threshold", type=float, help="least similarity of near duplicates, 0 to 100 (80)")
    p.add_argument("--ignore", action="append", default=[], help="text in paths to leave out; may be repeated")
    p.add_argument("--git-only", action="store_true", help="only files that git tracks")
    p.add_argument("--config", help="file of key=value settings; flags go over it")
    p.add_argument("--output", help="text report (report.txt)")
    p.add_argument("--html", help="HTML report")
    p.add_argument("--json", help="JSON report")
    p.add_argument("--pairs", help="folder for the table of all pairs")
    p.add_argument("--model", help="ONNX model, for semantic pairs")
    p.add_argument("--tokenizer", help="tokenizer.json of the model")
    p.add_argument("--semantic-zscore", type=float, dest="zscore", help="deviations above the mean of a semantic pair (2.5)")
    p.add_argument("--functions", metavar="FILE", help="print the functions of a file")
    p.add_argument("--tokenize", nargs=2, metavar=("TOKENIZER", "TEXT"), help="print the ids of a text")
    p.add_argument("--embed", nargs=3, metavar=("MODEL", "TOKENIZER", "TEXT"), help="print the first values of a text's vector")
    p.add_argument("--similarity", nargs="+", metavar="ARG", help="MODEL TOKENIZER TEXT...: print the texts' similarities")
    p.add_argument("--winnow", nargs=2, metavar="FILE", help="print the fingerprint similarity of two files")
    p.add_argument("--onnx-version", action="store_true", help="print the version of the model runtime")
    return p


def settings(args: argparse.Namespace) -> ScanConfig:
    """The config file's settings, with those of the command line over them; ignored texts add up."""
    c = load_config(args.config) if args.config else ScanConfig()
    for name in ("path", "threshold", "output", "html", "json", "model", "tokenizer", "zscore"):
        if (value := getattr(args, name)) is not None:
            setattr(c, name, value)
    c.ignore += args.ignore
    c.git_only |= args.git_only
    return c


def tool(args: argparse.Namespace) -> int | None:
    """Runs a single tool, if one is asked for."""
    from echoframe.functions.bpe import Tokenizer

    if args.onnx_version:
        import onnxruntime

        print(onnxruntime.__version__)
    elif args.functions:
        from echoframe.sources.functions_in import functions_in

        with open(args.functions, encoding="utf-8", errors="replace") as f:
            for name, body, start in functions_in(f.read()):
                print(f"{name}\t{start}\t{len(body)}")
    elif args.tokenize:
        print(*Tokenizer.load(args.tokenize[0]).encode(args.tokenize[1]))
    elif args.embed or args.similarity:
        import onnxruntime

        from echoframe.operators.embed import run_model
        from echoframe.operators.semantic import scaled, unit_rows

        model, tokenizer, *texts = args.embed or args.similarity
        t, session = Tokenizer.load(tokenizer), onnxruntime.InferenceSession(model)
        vectors = [run_model(session, [t.encode(x)])[0] for x in texts]
        if args.embed:
            print(*vectors[0][:10])
        else:
            u = unit_rows(vectors)
            for i in range(len(u)):
                for j in range(i + 1, len(u)):
                    print(f"{i} {j} {scaled(u[i] @ u[j]):.2f}")
    elif args.winnow:
        from echoframe.functions.normalize import tokens
        from echoframe.functions.winnow import fingerprints, similarity

        spark = SparkSession.builder.getOrCreate()
        bodies = [open(p, encoding="utf-8", errors="replace").read() for p in args.winnow]
        row = spark.createDataFrame([tuple(bodies)], "a string, b string").select(fingerprints(tokens(F.col("a"))).alias("a"), fingerprints(tokens(F.col("b"))).alias("b"))
        print(f"{row.select(similarity(F.col('a'), F.col('b'))).first()[0]:.2f}")
    else:
        return None
    return 0


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    try:
        if (done := tool(args)) is not None:
            return done
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    c = settings(args)
    if not c.path:
        p.print_usage(sys.stderr)
        return 1
    if not 0 <= c.threshold <= 100:
        print("error: the threshold lies between 0 and 100", file=sys.stderr)
        return 1
    from echoframe.plans.scan import scan_tree
    from echoframe.reports.writers import write_html, write_json, write_pairs, write_text

    spark = SparkSession.builder.appName("echoframe").getOrCreate()
    result = scan_tree(spark, c)
    if result is None:
        print("error: no source files found", file=sys.stderr)
        return 1
    if result.units.isEmpty():
        print("warning: no functions found", file=sys.stderr)
    write_text(result, c.path, sys.stdout, color=sys.stdout.isatty())
    for path, write in ((c.output, write_text), (c.html, write_html), (c.json, write_json)):
        if path:
            with open(path, "w", encoding="utf-8") as out:
                write(result, c.path, out)
    if args.pairs:
        write_pairs(result, args.pairs)
    return 0


if __name__ == "__main__":
    sys.exit(main())
