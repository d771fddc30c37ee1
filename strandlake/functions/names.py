"""Expressions over names of contigs and samples, and over query strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The pattern of a short name, the extensions that a sample's name loses, and the forms of a query.
SHORT_NAME = "^[^ \\t\\r\\n]*"
LAST_EXTENSION, SEQUENCE_EXTENSIONS = "(?<=.)\\.[^.]*$", "(?<=.)(\\.fna|\\.gz|\\.fa|\\.fasta)+$"
FULL, WITH_SAMPLE, WITH_RANGE = "(?s)^(.+)@(.+):(.+)-(.+)$", "(?s)^(.+)@(.+)$", "(?s)^(.+):(.+)-(.+)$"


def short_name(name: Column) -> Column:
    """A contig's name up to the first blank, tab or line end."""
    return F.regexp_extract(name, SHORT_NAME, 0)


def sample_name(path: Column) -> Column:
    """File name without its last extension, then without further sequence extensions."""
    file = F.regexp_extract(path, "[^/]*$", 0)
    stem = F.regexp_replace(file, LAST_EXTENSION, "")
    return F.regexp_replace(stem, SEQUENCE_EXTENSIONS, "")


def _number(text: Column) -> Column:
    """Leading integer of a text; 0 if there is none."""
    return F.coalesce(F.regexp_extract(text, "^[ ]*([+-]?[0-9]{1,18})", 1).try_cast("long"), F.lit(0).cast("long"))


def contig_query(query: Column) -> Column:
    """Struct (ok, contig, sample, from, to) of ``contig[@sample][:from-to]``; greedy, and -1 for an open bound."""
    part = lambda pattern, i: F.regexp_extract(query, pattern, i)
    make = lambda ok, contig, sample, low, high: F.struct(ok.alias("ok"), contig.alias("contig"), sample.alias("sample"), low.alias("from"), high.alias("to"))
    none, yes, whole = F.lit(""), F.lit(True), F.lit(-1).cast("long")
    return (
        F.when(query.rlike(FULL), make(yes, part(FULL, 1), part(FULL, 2), _number(part(FULL, 3)), _number(part(FULL, 4))))
        .when(query.rlike(WITH_SAMPLE), make(yes, part(WITH_SAMPLE, 1), part(WITH_SAMPLE, 2), whole, whole))
        .when(query.rlike(WITH_RANGE), make(yes, part(WITH_RANGE, 1), none, _number(part(WITH_RANGE, 2)), _number(part(WITH_RANGE, 3))))
        .when(query != "", make(yes, query, none, whole, whole))
        .otherwise(make(F.lit(False), none, none, whole, whole))
    )


def normalised_range(low: Column, high: Column) -> Column:
    """Struct (from, to): both open or crossed means the whole contig; one open end means that end of it."""
    most = F.lit((1 << 63) - 1).cast("long")
    start = F.when((low < 0) & (high < 0), 0).when(low < 0, 0).otherwise(low).cast("long")
    end = F.when(high < 0, most).otherwise(high)
    crossed = start > end
    return F.struct(F.when(crossed, 0).otherwise(start).cast("long").alias("from"), F.when(crossed, most).otherwise(end).alias("to"))


def slice_range(s: Column, low: Column, high: Column) -> Column:
    """Positions ``low`` to ``high``, counted from 0 and both included; what lies after the end is cut."""
    n = F.char_length(s).cast("long")
    end = F.least(high, n - 1)
    return F.when(end < low, "").otherwise(F.substring(s, (low + 1).cast("int"), F.greatest(end - low + 1, F.lit(0)).cast("int")))
