"""Command line: ``python -m strandlake VERB ...`` with the nine verbs of a collection.

    create   -o COLLECTION [-k K] [-s SEGMENT] [-l MATCH] [-b PACK] [-a] [-c] [-d] [-f SHARE] [-i LIST] REFERENCE.fa [FILE.fa ...]
    append   -o COLLECTION [-a] [-c] [-d] [-f SHARE] [-i LIST] FILE.fa ...
    getcol   [-o FOLDER] [-l WIDTH] [-g LEVEL] [-f] [-r] COLLECTION
    getset   [-o FILE] [-l WIDTH] [-g LEVEL] [-p] [-s] COLLECTION SAMPLE ...
    getctg   [-o FILE] [-l WIDTH] [-g LEVEL] [-p] [-s] COLLECTION CONTIG[@SAMPLE][:FROM-TO] ...
    listref | listset [-o FILE] COLLECTION
    listctg  [-o FILE] COLLECTION SAMPLE ...
    info     [-v LEVEL] COLLECTION

Without ``-o``, extraction goes to standard output; ``getcol -o`` writes a file per sample into the folder. ``-s`` puts out
segment after segment without building contigs. ``-f`` of getcol keeps groups in memory, ``-p`` does not. ``-t`` and ``-v``
are taken everywhere; threads are Spark's business.
"""

from __future__ import annotations

import argparse
import sys
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fasta_record
from .operators import grouping
from .operators.archive import Collection
from .sources.fasta import list_files, read_fasta, read_file_list, stream_lines, write_file, write_samples

# Fixed values: (default, least, most) line length; shorter or longer ones are moved to the nearest bound.
WIDTH = (80, 40, 2_000_000_000)


def contigs_of_files(spark: SparkSession, paths: list[str], concatenated: bool = False) -> DataFrame:
    """Contigs of FASTA files with ``sample_ord`` in the order of the files; repeated paths count once.

    ``concatenated``: all contigs are samples of their own, numbered over files in their order.
    """
    found = read_fasta(spark, paths, concatenated)
    columns = ["sample_ord", "sample", "contig_ord", "contig", "contig_full", "seq"]
    if not concatenated:
        return found.withColumnRenamed("file_ord", "sample_ord").select(*columns)
    ranks = grouping.numbered(found.select("file_ord", F.col("contig_ord").alias("nth")), ["file_ord", "nth"], 0, "sample_ord")
    joined = found.withColumnRenamed("contig_ord", "nth").join(ranks, ["file_ord", "nth"])
    return joined.select(F.col("sample_ord").cast("int").alias("sample_ord"), "sample", F.lit(0).alias("contig_ord"), "contig", "contig_full", "seq")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandlake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb in ("create", "append"):
        p = verbs.add_parser(verb)
        p.add_argument("-o", "--out", required=True)
        p.add_argument("-a", "--adaptive", action="store_true")
        p.add_argument("-c", "--concatenated", action="store_true")
        p.add_argument("-d", "--no-command", action="store_true")
        p.add_argument("-f", "--fallback", type=float)
        p.add_argument("-i", "--list")
        p.add_argument("files", nargs="*")
        if verb == "create":
            for short, name in (("-k", "k"), ("-s", "segment_size"), ("-l", "min_match"), ("-b", "pack_cardinality")):
                p.add_argument(short, dest=name, type=int)
    for verb in ("getcol", "getset", "getctg"):
        p = verbs.add_parser(verb)
        p.add_argument("-o", "--out")
        p.add_argument("-l", "--width", type=int, default=WIDTH[0])
        p.add_argument("-g", "--gzip", type=int, default=0)
        if verb == "getcol":
            p.add_argument("-f", "--fast", action="store_true")
            p.add_argument("-r", "--no-reference", action="store_true")
        else:
            p.add_argument("-p", "--no-prefetch", action="store_true")
            p.add_argument("-s", "--streaming", action="store_true")
        p.add_argument("collection")
        if verb != "getcol":
            p.add_argument("names", nargs="+")
    for verb in ("listref", "listset", "listctg", "info"):
        p = verbs.add_parser(verb)
        p.add_argument("-o", "--out")
        p.add_argument("collection")
        if verb == "listctg":
            p.add_argument("names", nargs="+")
    for p in verbs.choices.values():
        p.add_argument("-t", "--threads", type=int)
        p.add_argument("-v", "--verbosity", type=int, default=0)
    return top


def _ingest(spark: SparkSession, a: argparse.Namespace, command: str) -> None:
    files = list(dict.fromkeys(a.files + (read_file_list(spark, a.list) if a.list else [])))
    if not files:
        raise SystemExit("no input files")
    contigs = contigs_of_files(spark, files, a.concatenated)
    command = "" if a.no_command else command
    if a.verb == "create":
        Collection.create(contigs, a.out, a.k, a.segment_size, a.min_match, a.pack_cardinality, a.adaptive, command, a.fallback, a.concatenated, overwrite=True)
    else:
        Collection(spark, a.out).append(contigs, a.adaptive, command, a.fallback)
    if not a.concatenated:
        held = {r["sample_ord"] for r in contigs.select("sample_ord").distinct().collect()}  # one per file
        for i, path in {i: path for i, path, _ in list_files(spark, files)}.items():
            if i not in held:
                warnings.warn(f"{path} contains no contigs and is not part of the collection", stacklevel=2)


def _extracted(spark: SparkSession, a: argparse.Namespace, c: Collection) -> tuple[DataFrame, list[str], str]:
    """What getset and getctg put out, the order of its rows, and which column is the header."""
    if a.verb == "getset":
        return c.get_samples(a.names), ["argument", "contig_ord"], "contig_full"
    return c.get_contigs(a.names), ["query_ord"], "header"


def _streamed(spark: SparkSession, a: argparse.Namespace, c: Collection) -> Iterator[str]:
    whole = (F.lit(0).cast("long").alias("low"), F.lit((1 << 62)).cast("long").alias("high"))
    if a.verb == "getset":
        c.get_samples(a.names)  # a name that is missing is an error
        asked = spark.createDataFrame(list(enumerate(a.names)), "argument int, sample string")
        rows = c.contigs().join(asked, "sample").select(F.struct("argument", "contig_ord").alias("place"), F.col("contig_full").alias("header"), "sample_ord", "contig_ord", *whole)
    else:
        rows = c.resolved(a.names).select(F.struct("query_ord").alias("place"), "header", "sample_ord", "contig_ord", "low", "high")
    yield from c.stream_records(rows, a.width)


def _unknown(c: Collection, names: list[str]) -> None:
    """An unknown or ambiguous contig stops the command."""
    bad = c.resolved(names).where("status <> 0").orderBy("query_ord").limit(1).collect()
    if bad:
        raise SystemExit(f"{names[bad[0]['query_ord']]}: {'no such contig' if bad[0]['status'] == -1 else 'in several samples'}")


def _listed(a: argparse.Namespace, c: Collection) -> Iterator[str]:
    if a.verb == "listref":
        yield c.reference_sample() or ""
    elif a.verb == "listset":
        yield from (f"{s}\n" for s in c.list_samples())
    elif a.verb == "listctg":
        for sample in a.names:
            yield f"{sample}\n"
            yield from (f"   {x}\n" for x in c.list_contigs(sample))
    else:
        yield from (f"{k}: {v}\n" for k, v in c.info().first().asDict().items())
        if a.verbosity > 0:
            yield "file type info\n"
            yield from (f"   {k}: {v}\n" for k, v in sorted(c.file_info().items()))
            yield from (f"   {k}: {v}\n" for k, v in c.sizes().first().asDict().items())


def run(spark: SparkSession, argv: list[str]) -> Iterator[str]:
    """Runs one command; yields what goes to standard output."""
    a = parser().parse_args(argv)
    if a.verb in ("create", "append"):
        _ingest(spark, a, " ".join(["strandlake", *argv]))
        return
    if a.verb.startswith("get"):
        a.width = min(max(a.width, WIDTH[1]), WIDTH[2])
    with Collection(spark, a.collection, prefetch=bool(getattr(a, "fast", False) or not getattr(a, "no_prefetch", True))) as c:
        if a.verb in ("listref", "listset", "listctg", "info"):
            text = _listed(a, c)
            if not a.out:
                yield from text
            else:
                write_file(spark.createDataFrame([(0, "".join(text))], "n int, value string"), ["n"], a.out)
            return
        if a.verb == "getcol":
            contigs = c.contigs_with_sequences(skip_reference=a.no_reference)
            if a.out:
                write_samples(contigs, a.out, a.width, a.gzip)
            else:
                yield from stream_lines(contigs, a.width)
            return
        if a.verb == "getctg":
            _unknown(c, a.names)
        if a.out:
            rows, order, header = _extracted(spark, a, c)
            write_file(rows.select(*order, fasta_record(F.col(header), F.col("seq"), a.width).alias("value")), order, a.out, a.gzip)
        elif a.streaming:
            yield from _streamed(spark, a, c)
        else:
            rows, order, header = _extracted(spark, a, c)
            yield from stream_lines(rows, a.width, tuple(order), header)


def main() -> None:
    spark = SparkSession.builder.appName("strandlake").getOrCreate()
    for text in run(spark, sys.argv[1:]):
        sys.stdout.write(text)
