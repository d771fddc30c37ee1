"""Catalog, names, ranges, extraction, and text output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import catalog
from ..sources.fasta import records_of
from ..sources.genome_view import K, MIN_MATCH, SEGMENT_SIZE, contigs_of
from .views import genome

WANTED = ("src3", "src0", "nosuch", "src3")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(WANTED)), "argument int, sample string")


def _queries(spark: SparkSession, d: str, whole: bool) -> DataFrame:
    """A range query for every document."""
    i = F.col("doc_id")
    low = F.lit(-1).cast("long") if whole else (i % 97) * 3 - 5
    high = F.lit(-1).cast("long") if whole else (i % 97) * 3 + (i % 211)
    return _docs(spark, d).select(i.alias("query_ord"), F.col("source").alias("sample"), F.concat(F.lit("doc"), i.cast("string")).alias("contig"), low.alias("from"), high.alias("to"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Query strings of every form, one per document."""
    i, c = F.col("doc_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    low, high = (i % 50).cast("string"), (i % 50 + 40).cast("string")
    form = (
        F.when(i % 7 == 0, F.concat(c, F.lit("@"), "source", F.lit(":"), low, F.lit("-"), high))
        .when(i % 7 == 1, F.concat(c, F.lit("@"), "source"))
        .when(i % 7 == 2, F.concat(c, F.lit(":"), low, F.lit("-"), high))
        .when(i % 7 == 3, c)
        .when(i % 7 == 4, F.concat(F.lit("a@b@"), "source"))
        .when(i % 7 == 5, F.concat(c, F.lit(":x-"), high))
        .otherwise(F.when(i % 2 == 0, "").otherwise(F.concat(c, F.lit(":1-2-"), high)))
    )
    return _docs(spark, d).select("doc_id", form.alias("query"))


_TEXT_SQL = """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'doc' || doc_id || '@' || source || ':' || (doc_id % 50) || '-' || (doc_id % 50 + 40)
 WHEN 1 THEN 'doc' || doc_id || '@' || source WHEN 2 THEN 'doc' || doc_id || ':' || (doc_id % 50) || '-' || (doc_id % 50 + 40) WHEN 3 THEN 'doc' || doc_id
 WHEN 4 THEN 'a@b@' || source WHEN 5 THEN 'doc' || doc_id || ':x-' || (doc_id % 50 + 40)
 ELSE CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'doc' || doc_id || ':1-2-' || (doc_id % 50 + 40) END END AS query FROM documents"""
_FULL, _SAMPLE, _RANGE = "^(.+)@(.+):(.+)-(.+)$", "^(.+)@(.+)$", "^(.+):(.+)-(.+)$"


def _num(pattern: str, i: int) -> str:
    return f"coalesce(try_cast(regexp_extract(regexp_extract(query, '{pattern}', {i}), '^[ ]*([+-]?[0-9]+)', 1) AS BIGINT), 0)"


_PARSED_SQL = f"""SELECT doc_id, query, query <> '' AS ok,
 CASE WHEN regexp_matches(query, '{_FULL}') THEN regexp_extract(query, '{_FULL}', 1) WHEN regexp_matches(query, '{_SAMPLE}') THEN regexp_extract(query, '{_SAMPLE}', 1)
  WHEN regexp_matches(query, '{_RANGE}') THEN regexp_extract(query, '{_RANGE}', 1) ELSE query END AS contig,
 CASE WHEN regexp_matches(query, '{_FULL}') THEN regexp_extract(query, '{_FULL}', 2) WHEN regexp_matches(query, '{_SAMPLE}') THEN regexp_extract(query, '{_SAMPLE}', 2) ELSE '' END AS sample,
 CASE WHEN regexp_matches(query, '{_FULL}') THEN {_num(_FULL, 3)} WHEN regexp_matches(query, '{_SAMPLE}') THEN -1 WHEN regexp_matches(query, '{_RANGE}') THEN {_num(_RANGE, 2)} ELSE -1 END AS "from",
 CASE WHEN regexp_matches(query, '{_FULL}') THEN {_num(_FULL, 4)} WHEN regexp_matches(query, '{_SAMPLE}') THEN -1 WHEN regexp_matches(query, '{_RANGE}') THEN {_num(_RANGE, 3)} ELSE -1 END AS "to"
 FROM ({_TEXT_SQL})"""


def list_samples(spark, d):
    return catalog.list_samples(contigs_of(spark, d))


def list_samples_ingest_order(spark, d):
    return catalog.list_samples(contigs_of(spark, d), by_name=False)


def reference_sample(spark, d):
    return catalog.reference_sample(contigs_of(spark, d))


def n_samples(spark, d):
    return catalog.count_samples(contigs_of(spark, d))


def list_contigs(spark, d):
    return catalog.list_contigs(contigs_of(spark, d))


def n_contigs(spark, d):
    return catalog.count_contigs(contigs_of(spark, d), _samples(spark).select("sample").distinct())


def contig_length(spark, d):
    return catalog.contig_lengths(contigs_of(spark, d))


def info(spark, d):
    return catalog.info(contigs_of(spark, d), k=K, min_match=MIN_MATCH, segment_size=SEGMENT_SIZE)


def contig_short_name(spark, d):
    return contigs_of(spark, d).select("contig_full", fn.short_name(F.col("contig_full")).alias("short_name"))


def sample_name_from_path(spark, d):
    i = F.col("doc_id") % 8
    ending = F.element_at(F.array(*[F.lit(x) for x in (".fa", ".fna.gz", ".v1.fa", ".txt", ".fa.fasta", ".fasta.gz", "", ".a.b.gz")]), (i + 1).cast("int"))
    path = F.concat(F.lit("in/"), "source", F.lit("/x"), F.col("doc_id").cast("string"), ending)
    return _docs(spark, d).select(path.alias("path"), fn.sample_name(path).alias("sample"))


def parse_contig_query(spark, d):
    return _texts(spark, d).withColumn("q", fn.contig_query(F.col("query"))).select("doc_id", "query", "q.*")


def normalise_range(spark, d):
    low, high = F.col("doc_id") % 40 - 10, F.col("doc_id") % 23 - 5
    return _docs(spark, d).select("doc_id", low.alias("low"), high.alias("high"), fn.normalised_range(low, high).alias("r")).select("doc_id", "low", "high", F.col("r.from").alias("start"), F.col("r.to").alias("stop"))


def getctg_range(spark, d):
    return catalog.get_ranges(contigs_of(spark, d), _queries(spark, d, False))


def getctg_whole(spark, d):
    return catalog.get_ranges(contigs_of(spark, d), _queries(spark, d, True))


def _names(spark, d):
    """Short names of three kinds: unique ones, ones that several contigs share (their language), missing ones."""
    i = F.col("doc_id")
    return _docs(spark, d).select(F.when(i % 3 == 0, F.concat(F.lit("doc"), i.cast("string"))).when(i % 3 == 1, F.col("lang")).otherwise(F.concat(F.lit("none"), (i % 10).cast("string"))).alias("contig")).distinct()


def _by_lang(spark, d):
    """A second naming of the same contigs, where names repeat."""
    c = contigs_of(spark, d)
    lang = F.element_at(F.split("contig_full", " "), -1)
    return c.select("sample", c.contig).union(c.select("sample", lang))


def getctg_ambiguous(spark, d):
    return catalog.resolve(_by_lang(spark, d), _names(spark, d))


def samples_for_contig(spark, d):
    return catalog.samples_for(_by_lang(spark, d), _names(spark, d))


def contig_exists(spark, d):
    i = F.col("doc_id")
    wanted = _docs(spark, d).select(F.when(i % 2 == 0, F.col("source")).otherwise("src1").alias("sample"), F.concat(F.lit("doc"), i.cast("string")).alias("contig"))
    return catalog.exists(contigs_of(spark, d), wanted)


def getset(spark, d):
    return catalog.get_samples(contigs_of(spark, d), _samples(spark))


def getcol(spark, d):
    return catalog.get_collection(contigs_of(spark, d))


def getcol_no_ref(spark, d):
    return catalog.get_collection(contigs_of(spark, d), skip_reference=True)


def fasta_wrap(spark, d):
    return contigs_of(spark, d).select("contig", fn.fasta_record(F.col("contig_full"), F.col("seq"), 60).alias("record"))


def fasta_records(spark, d):
    """Records as written, read back."""
    text = contigs_of(spark, d).select("contig", fn.fasta_record(F.col("contig_full"), F.col("seq"), 60).alias("value"))
    return records_of(text).select("contig", "header", fn.normalise_symbols(F.col("body")).alias("seq"))


def concatenated_genomes(spark, d):
    """Every contig as a sample of its own."""
    return contigs_of(spark, d).select(fn.short_name(F.col("contig_full")).alias("sample"), "contig_full", F.char_length("seq").cast("long").alias("length"))


def file_sizes(spark, d):
    """Letters and bytes of each sample as FASTA text."""
    c = contigs_of(spark, d)
    record = fn.fasta_record(F.col("contig_full"), F.col("seq"), 80)
    return c.groupBy("sample").agg(F.sum(F.octet_length(record)).cast("long").alias("bytes"), F.sum(F.char_length("seq")).cast("long").alias("letters"))


def distinct_paths(spark, d):
    """Input paths without repeats, in order of first use."""
    paths = _docs(spark, d).select("doc_id", F.concat(F.lit("in/"), "source", F.lit(".fa")).alias("path"))
    first = paths.groupBy("path").agg(F.min("doc_id").alias("first"))
    return first.select("path", "first")


def normalise_symbols(spark, d):
    return _docs(spark, d).select("doc_id", fn.normalise_symbols(F.col("text")).alias("seq"))


def reverse_complement(spark, d):
    return _docs(spark, d).select("doc_id", fn.reverse_complement(fn.iupac_view(F.col("text"))).alias("rc"))


def dna_codes(spark, d):
    letters = F.split(fn.iupac_view(F.col("text")), "")
    each = _docs(spark, d).select("doc_id", F.explode(F.filter(letters, lambda c: c != "")).alias("letter"))
    return each.groupBy("letter").agg(F.count(F.lit(1)).alias("n")).select("letter", "n", fn.dna_code(F.col("letter")).cast("long").alias("code"))


def contig_checksum(spark, d):
    return contigs_of(spark, d).select("contig", fn.base_sum(F.col("seq")).alias("checksum"))


def n_runs(spark, d):
    """Runs of N of the ambiguity view; blanks of prose make the runs: letters other than A, C, G, T count as N."""
    s = F.regexp_replace(fn.iupac_view(F.col("text")), "[^ACGT]", "N")
    return _docs(spark, d).select("doc_id", F.explode(fn.n_runs(s)).alias("run")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("run").cast("long").alias("letters"), F.max("run").cast("long").alias("longest"))


def self_similarity(spark, d):
    return contigs_of(spark, d).select("contig", F.round(fn.self_similarity(F.col("seq")), 9).alias("similarity"))


_WANTED_SQL = "(VALUES (0, 'src3'), (1, 'src0'), (2, 'nosuch'), (3, 'src3')) AS v(argument, sample)"
_IUPAC = "translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), 'ACGTNRYSWKMBDHVUEFIJLOPQXZacgtnryswkmbdhvuefijlopqxz', 'ACGTNRYSWKMBDHVU          ACGTNRYSWKMBDHVU          ')"
_RECORD = "'>' || contig_full || chr(10) || regexp_replace(seq, '(.{1,%d})', '\\1' || chr(10), 'g')"
_RANGES = """SELECT query_ord, CASE WHEN f < 0 AND t < 0 THEN contig_full ELSE contig_full || ':' || f || '-' || t END AS header,
 CASE WHEN lo > hi THEN seq ELSE substr(seq, lo + 1, least(hi, length(seq)) - lo + 1) END AS seq FROM (
 SELECT query_ord, contig_full, seq, f, t, CASE WHEN f < 0 THEN 0 ELSE f END AS lo, CASE WHEN t < 0 THEN 9000000000000000 ELSE t END AS hi
 FROM (SELECT doc_id AS query_ord, source AS qs, 'doc' || doc_id AS qc, %s AS f, %s AS t FROM documents) q JOIN g ON g.sample = q.qs AND g.contig = q.qc)"""
_BY_LANG = "both_names AS (SELECT sample, contig FROM g UNION ALL SELECT sample, split_part(contig_full, ' ', 2) FROM g)"
_NAMES = "names AS (SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN 'doc' || doc_id WHEN 1 THEN lang ELSE 'none' || (doc_id % 10) END AS contig FROM documents)"

QUERIES = {f.__name__: f for f in (
    list_samples, list_samples_ingest_order, reference_sample, n_samples, list_contigs, n_contigs, contig_length, info, contig_short_name,
    sample_name_from_path, parse_contig_query, normalise_range, getctg_range, getctg_whole, getctg_ambiguous, samples_for_contig, contig_exists,
    getset, getcol, getcol_no_ref, fasta_wrap, fasta_records, concatenated_genomes, file_sizes, distinct_paths, normalise_symbols,
    reverse_complement, dna_codes, contig_checksum, n_runs, self_similarity,
)}

ORACLES = {
    "list_samples": genome("SELECT row_number() OVER (ORDER BY sample) - 1 AS position, sample FROM s"),
    "list_samples_ingest_order": genome("SELECT CAST(sample_ord AS BIGINT) AS position, sample FROM s"),
    "reference_sample": genome("SELECT sample FROM s WHERE sample_ord = 0"),
    "n_samples": "SELECT count(DISTINCT source) AS n_samples FROM documents",
    "list_contigs": genome("SELECT sample, contig_ord, contig_full FROM g"),
    "n_contigs": genome(f"SELECT v.sample, CAST(CASE WHEN count(g.contig) = 0 THEN -1 ELSE count(g.contig) END AS BIGINT) AS n_contigs FROM (SELECT DISTINCT sample FROM {_WANTED_SQL}) v LEFT JOIN g USING (sample) GROUP BY v.sample"),
    "contig_length": genome("SELECT sample, contig, length(seq) AS length FROM g"),
    "info": genome(f"SELECT count(DISTINCT sample) AS n_samples, count(*) AS n_contigs, CAST(sum(length(seq)) AS BIGINT) AS n_letters, max(CASE WHEN sample_ord = 0 THEN sample END) AS reference, CAST({K} AS BIGINT) AS k, CAST({MIN_MATCH} AS BIGINT) AS min_match, CAST({SEGMENT_SIZE} AS BIGINT) AS segment_size FROM g"),
    "contig_short_name": genome("SELECT contig_full, split_part(contig_full, ' ', 1) AS short_name FROM g"),
    "sample_name_from_path": "SELECT path, regexp_replace(regexp_replace(file, '(.)\\.[^.]*$', '\\1'), '(.)(\\.fna|\\.gz|\\.fa|\\.fasta)+$', '\\1') AS sample FROM (SELECT path, regexp_extract(path, '[^/]*$') AS file FROM (SELECT 'in/' || source || '/x' || doc_id || CASE doc_id % 8 WHEN 0 THEN '.fa' WHEN 1 THEN '.fna.gz' WHEN 2 THEN '.v1.fa' WHEN 3 THEN '.txt' WHEN 4 THEN '.fa.fasta' WHEN 5 THEN '.fasta.gz' WHEN 6 THEN '' ELSE '.a.b.gz' END AS path FROM documents))",
    "parse_contig_query": _PARSED_SQL,
    "normalise_range": "SELECT doc_id, low, high, CASE WHEN lo > hi THEN 0 ELSE lo END AS start, CASE WHEN lo > hi THEN 9223372036854775807 ELSE hi END AS stop FROM (SELECT doc_id, low, high, CASE WHEN low < 0 THEN 0 ELSE low END AS lo, CASE WHEN high < 0 THEN 9223372036854775807 ELSE high END AS hi FROM (SELECT doc_id, doc_id % 40 - 10 AS low, doc_id % 23 - 5 AS high FROM documents))",
    "getctg_range": genome(_RANGES % ("(doc_id % 97) * 3 - 5", "(doc_id % 97) * 3 + (doc_id % 211)")),
    "getctg_whole": genome(_RANGES % ("-1", "-1")),
    "getctg_ambiguous": genome(f", {_NAMES}, {_BY_LANG} SELECT contig, CAST(CASE WHEN n = 0 THEN -1 WHEN n > 1 THEN -2 ELSE 0 END AS INTEGER) AS status, CASE WHEN n = 1 THEN one END AS sample FROM (SELECT names.contig, count(both_names.contig) AS n, min(both_names.sample) AS one FROM names LEFT JOIN both_names USING (contig) GROUP BY names.contig)"),
    "samples_for_contig": genome(f", {_NAMES}, {_BY_LANG} SELECT contig, sample FROM both_names JOIN names USING (contig)"),
    "contig_exists": genome("SELECT q.sample, q.contig FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN source ELSE 'src1' END AS sample, 'doc' || doc_id AS contig FROM documents) q WHERE EXISTS (SELECT 1 FROM g WHERE g.sample = q.sample AND g.contig = q.contig)"),
    "getset": genome(f"SELECT v.argument, g.contig_ord, g.contig_full, g.seq FROM {_WANTED_SQL} JOIN g USING (sample)"),
    "getcol": genome("SELECT sample_ord, contig_ord, contig_full, seq FROM g"),
    "getcol_no_ref": genome("SELECT sample_ord, contig_ord, contig_full, seq FROM g WHERE sample_ord > 0"),
    "fasta_wrap": genome(f"SELECT contig, {_RECORD % 60} AS record FROM g"),
    "fasta_records": genome("SELECT contig, contig_full AS header, seq FROM g"),
    "concatenated_genomes": genome("SELECT contig AS sample, contig_full, length(seq) AS length FROM g"),
    "file_sizes": genome(f"SELECT sample, CAST(sum(strlen({_RECORD % 80})) AS BIGINT) AS bytes, CAST(sum(length(seq)) AS BIGINT) AS letters FROM g GROUP BY sample"),
    "distinct_paths": "SELECT 'in/' || source || '.fa' AS path, min(doc_id) AS first FROM documents GROUP BY source",
    "normalise_symbols": f"SELECT doc_id, {_IUPAC} AS seq FROM documents",
    "reverse_complement": f"SELECT doc_id, reverse(translate({_IUPAC}, 'ACGT', 'TGCA')) AS rc FROM documents",
    "dna_codes": f"SELECT letter, count(*) AS n, CAST(CASE letter WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END AS BIGINT) AS code FROM (SELECT unnest(string_split({_IUPAC}, '')) AS letter FROM documents) WHERE letter <> '' GROUP BY letter",
    "contig_checksum": genome("SELECT contig, CAST(65 * (length(seq) - length(replace(seq, 'A', ''))) + 67 * (length(seq) - length(replace(seq, 'C', ''))) + 71 * (length(seq) - length(replace(seq, 'G', ''))) + 84 * (length(seq) - length(replace(seq, 'T', ''))) AS BIGINT) AS checksum FROM g"),
    "n_runs": f"SELECT doc_id, count(*) AS n, CAST(sum(length(run)) AS BIGINT) AS letters, max(length(run)) AS longest FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace({_IUPAC}, '[^ACGT]', 'N', 'g'), 'N{{4,}}')) AS run FROM documents) GROUP BY doc_id",
    "self_similarity": genome("SELECT contig, round(coalesce(CASE WHEN len(l) > 0 THEN list_max(list_transform(range(4, 32), lambda lag: len(list_filter(range(lag + 1, len(l) + 1), lambda i: l[i] = l[i - lag])) / len(l)::DOUBLE)) END, 0), 9) AS similarity FROM (SELECT contig, list_filter(string_split(seq, ''), lambda c: c <> '') AS l FROM g)"),
}
