"""Integer, name and symbol encodings, and what is derived from groups for storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..functions import packing
from ..operators import codec, grouping, kmers
from ..sources.fasta import records_of, with_codes
from ..sources.genome_view import K, MIN_MATCH, SEGMENT_SIZE, contigs_of
from ..sources.shipping import ship
from .codec_queries import _lz_oracle, kept_keyed, with_references
from .segment_queries import keyed_of
from .views import genome
from .views import kmers as kmers_sql
from .views import segments as sql

_NEAR = SEGMENT_SIZE + K


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    """A number of up to 32 bits for every document, of every size."""
    n = F.expr("shiftright(pmod(doc_id * 2654435761, 4294967296), CAST(doc_id % 5 * 7 AS INT))")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 11 == 0, 0).otherwise(n).alias("n"))


_NUMBERS = "(SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE ((doc_id * 2654435761) % 4294967296) >> CAST(doc_id % 5 * 7 AS BIGINT) END AS n FROM documents)"


def _joined(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def prefix_varints(spark, d):
    coded = _numbers(spark, d).withColumn("v", packing.prefix_varint(F.col("n")))
    return coded.select("doc_id", "n", _joined(F.col("v")).alias("bytes"), packing.from_prefix_varint(F.col("v")).alias("back"))


def sized_varints(spark, d):
    coded = _numbers(spark, d).withColumn("v", packing.sized_varint(F.col("n")))
    return coded.select("doc_id", "n", _joined(F.col("v")).alias("bytes"), packing.from_sized_varint(F.col("v")).alias("back"))


def zigzags(spark, d):
    x = (F.col("doc_id") % 101 - 50).cast("long")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", fn.zigzag(x).cast("long").alias("code"), packing.zigzag_decode(fn.zigzag(x)).alias("back"))


def hashes_and_bits(spark, d):
    n = F.col("n")
    return _numbers(spark, d).select("doc_id", packing.fmix32(n).alias("mixed"), F.bit_count(n).cast("long").alias("ones"), packing.n_bits(n).cast("long").alias("bits"), packing.n_bytes(n).cast("long").alias("bytes"), packing.is_power_of_two(n).alias("power"))


def stream_names(spark, d):
    return _numbers(spark, d).select("doc_id", fn.base64_name(F.col("n")).alias("name64"), fn.hex_name(F.col("n")).alias("name16"))


def packed_symbols(spark, d):
    """Sequences with symbols of four ranges, packed and back."""
    kind = F.col("contig_ord") % 4
    seq = F.when(kind == 0, F.col("seq")).when(kind == 1, F.translate("seq", "T", "N")).when(kind == 2, F.translate("seq", "T", "U")).otherwise(F.translate("seq", "T", " "))
    return codec.pack_rows(contigs_of(spark, d).select("contig", seq.alias("seq")))


def coded_scan(spark, d):
    """Records as written, read back as numbers of symbols."""
    text = contigs_of(spark, d).select("contig", fn.fasta_record(F.col("contig_full"), F.col("seq"), 60).alias("value"))
    read = with_codes(records_of(text).select("contig", fn.normalise_symbols(F.col("body")).alias("seq")))
    return read.select("contig", F.size("codes").cast("long").alias("n"), F.aggregate("codes", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def letter_complements(spark, d):
    letters = F.filter(F.split(fn.iupac_view(F.col("text")), ""), lambda c: c != "")
    each = spark.read.parquet(f"{d}/documents.parquet").select(F.explode(letters).alias("letter"))
    return each.groupBy("letter").agg(F.count(F.lit(1)).alias("n")).select("letter", "n", packing.complement_letter(F.col("letter")).alias("other"))


def near_lengths(spark, d):
    """Lengths of segments relative to the expected one."""
    rows = keyed_of(spark, d).select(*grouping.ARRIVAL, "raw_length", packing.zigzag_near(F.col("raw_length"), F.lit(_NEAR)).alias("code"))
    return rows.withColumn("back", packing.zigzag_near_decode(F.col("code"), F.lit(_NEAR)))


def _members(spark, d):
    return with_references(spark, d).select(*grouping.ARRIVAL, "key1", "key2", "body")


def shared_in_group_ids(spark, d):
    return grouping.shared_ids(_members(spark, d))


def near_in_group_ids(spark, d):
    return grouping.near_ids(grouping.shared_ids(_members(spark, d)))


def candidate_order(spark, d):
    keyed = kept_keyed(spark, d)
    refs = with_references(spark, d, keyed).select("key1", "key2", F.char_length("ref_seq").alias("ref_length")).distinct()
    return grouping.candidate_order(keyed.where("(front is null) <> (back is null)"), refs)


def kmer_ranks(spark, d):
    return kmers.ranked(kmers.canonical_kmers(contigs_of(spark, d).where("sample_ord = 0"), K))


def reference_packing(spark, d):
    """How the references of groups are stored: symbols packed, unless the sequence repeats itself; and how large before
    compression."""
    refs = with_references(spark, d).select("key1", "key2", "ref_seq").distinct().withColumn("codes", packing.symbol_codes(F.col("ref_seq")))
    repeats = fn.self_similarity(F.col("ref_seq")) >= 0.5
    size = F.when(repeats, F.size("codes")).otherwise(F.size(packing.pack_symbols(F.col("codes"))))
    return refs.select("key1", "key2", F.when(repeats, packing.ZSTD_PLAIN).otherwise(packing.ZSTD_TUPLES).alias("kind"), size.cast("long").alias("size"))


def lz_first_form(spark, d):
    """Coded in the older form and back."""
    rows = with_references(spark, d)
    coded = codec.encode_rows(rows.withColumn("ref2", F.col("ref_seq")), MIN_MATCH, first_form=True).withColumnRenamed("ref2", "ref_seq")
    return codec.decode_rows(coded, MIN_MATCH).select(*grouping.ARRIVAL, F.col("body").alias("seq"))


def contig_name_steps(spark, d):
    """Names of a sample's contigs as steps from the name before, and back."""
    ship(spark)

    @F.udf("string", useArrow=True)
    def there_and_back(before: str | None, name: str) -> str:
        return packing.name_after(before, packing.name_step(before, name))

    order = Window.partitionBy("sample_ord").orderBy("contig_ord")
    named = contigs_of(spark, d).select("sample_ord", "contig_ord", "contig_full", F.lag("contig_full").over(order).alias("before"))
    return named.select("sample_ord", "contig_ord", there_and_back("before", "contig_full").alias("contig_full"))


QUERIES = {f.__name__: f for f in (
    prefix_varints, sized_varints, zigzags, hashes_and_bits, stream_names, packed_symbols, coded_scan, letter_complements, near_lengths, shared_in_group_ids,
    near_in_group_ids, candidate_order, kmer_ranks, reference_packing, lz_first_form, contig_name_steps,
)}

_S = packing.PREFIX_STARTS
_byte = lambda x, p: f"(({x}) >> {8 * p}) & 255"
_PREFIX = "CASE " + " ".join(
    f"WHEN n < {_S[k + 1]} THEN concat_ws(',', {packing.PREFIXES[k]} + ({_byte(f'n - {_S[k]}', k)}){''.join(f', {_byte(f'n - {_S[k]}', p)}' for p in range(k - 1, -1, -1))})" for k in range(4)
) + f" ELSE concat_ws(',', {packing.PREFIXES[4]}, {', '.join(_byte(f'n - {_S[4]}', p) for p in (3, 2, 1, 0))}) END"
_SIZED = "CASE WHEN n = 0 THEN '0' " + " ".join(f"WHEN n < {1 << 8 * k} THEN concat_ws(',', {k}, {', '.join(_byte('n', p) for p in range(k - 1, -1, -1))})" for k in (1, 2, 3)) + f" ELSE concat_ws(',', 4, {', '.join(_byte('n', p) for p in (3, 2, 1, 0))}) END"
_MIX = "WITH a AS (SELECT doc_id, n, xor(n, n >> 16) AS h FROM {t}), b AS (SELECT doc_id, n, CAST((h::HUGEINT * 2246822507) % 4294967296 AS BIGINT) AS h FROM a), c AS (SELECT doc_id, n, xor(h, h >> 13) AS h FROM b), e AS (SELECT doc_id, n, CAST((h::HUGEINT * 3266489909) % 4294967296 AS BIGINT) AS h FROM c) SELECT doc_id, xor(h, h >> 16) AS mixed, CAST(bit_count(n) AS BIGINT) AS ones, CAST(CASE WHEN n = 0 THEN 0 ELSE length(ltrim(bin(n), '0')) END AS BIGINT) AS bits, CAST(CASE WHEN n < 256 THEN 1 WHEN n < 65536 THEN 2 WHEN n < 16777216 THEN 3 ELSE 4 END AS BIGINT) AS bytes, bit_count(n) <= 1 AS power FROM e".format(t=_NUMBERS)
_D64 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_#"
_NAME64 = " || ".join(f"CASE WHEN {i} = 0 OR n >= {1 << 6 * i} THEN substr('{_D64}', CAST(((n >> {6 * i}) & 63) + 1 AS BIGINT), 1) ELSE '' END" for i in range(6))
_CODES = "list_transform(list_filter(string_split(CASE contig_ord % 4 WHEN 0 THEN seq WHEN 1 THEN replace(seq, 'T', 'N') WHEN 2 THEN replace(seq, 'T', 'U') ELSE replace(seq, 'T', ' ') END, ''), lambda c: c <> ''), lambda c: CASE WHEN instr('ACGTNRYSWKMBDHVU', c) > 0 THEN instr('ACGTNRYSWKMBDHVU', c) - 1 ELSE 30 END)"
_WIDTH = "CASE WHEN m < 4 THEN 4 WHEN m < 6 THEN 3 WHEN m < 16 THEN 2 ELSE 1 END"
_PACKED = "CASE WHEN w = 1 THEN list_append(l, 16) ELSE list_append(list_transform(range(0, len(l) // w + 1), lambda i: coalesce(list_sum(list_transform(range(1, len(l[i * w + 1:i * w + w]) + 1), lambda j: l[i * w + j] * CAST(pow(CASE w WHEN 4 THEN 4 WHEN 3 THEN 6 ELSE 16 END, len(l[i * w + 1:i * w + w]) - j) AS BIGINT))), 0)), w * 16 + len(l) % w) END"
_REFS = ", bd AS (SELECT sample_ord, contig_ord, place, key1, key2, CASE WHEN is_rev_comp THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS body FROM kd WHERE key1 IS NOT NULL), rf AS (SELECT key1, key2, body AS ref FROM (SELECT *, row_number() OVER (PARTITION BY key1, key2 ORDER BY sample_ord, contig_ord, place) AS r FROM bd) WHERE r = 1)"
_IDS = _REFS + ", ot AS (SELECT key1, key2, body, row_number() OVER (PARTITION BY key1, key2 ORDER BY s, c, p) AS n FROM (SELECT bd.key1, bd.key2, body, min((sample_ord, contig_ord, place)) AS f, f[1] AS s, f[2] AS c, f[3] AS p FROM bd JOIN rf USING (key1, key2) WHERE body <> ref GROUP BY bd.key1, bd.key2, body)), ids AS (SELECT sample_ord, contig_ord, place, bd.key1, bd.key2, CAST(coalesce(n, 0) AS BIGINT) AS in_group_id FROM bd LEFT JOIN ot ON ot.key1 = bd.key1 AND ot.key2 = bd.key2 AND ot.body = bd.body)"
_ARR = "sample_ord, contig_ord, place"
_SIMILAR = "coalesce(list_max(list_transform(range(4, 32), lambda lag: len(list_filter(range(lag + 1, len(l) + 1), lambda i: l[i] = l[i - lag])) / len(l)::DOUBLE)), 0)"

ORACLES = {
    "prefix_varints": f"SELECT doc_id, n, {_PREFIX} AS bytes, n AS back FROM {_NUMBERS}",
    "sized_varints": f"SELECT doc_id, n, {_SIZED} AS bytes, n AS back FROM {_NUMBERS}",
    "zigzags": "SELECT doc_id, CASE WHEN x >= 0 THEN 2 * x ELSE -2 * x - 1 END AS code, x AS back FROM (SELECT doc_id, doc_id % 101 - 50 AS x FROM documents)",
    "hashes_and_bits": _MIX,
    "stream_names": f"SELECT doc_id, {_NAME64} AS name64, reverse(format('{{:X}}', n)) AS name16 FROM {_NUMBERS}",
    "packed_symbols": genome(f"SELECT contig, w AS width, array_to_string({_PACKED}, ',') AS bytes, true AS same FROM (SELECT contig, l, CAST({_WIDTH} AS INTEGER) AS w FROM (SELECT contig, l, coalesce(list_max(l), 0) AS m FROM (SELECT contig, {_CODES} AS l FROM g)))"),
    "coded_scan": genome("SELECT contig, length(seq) AS n, CAST(length(replace(seq, 'A', '')) + length(seq) - length(replace(seq, 'G', '')) + 2 * (length(seq) - length(replace(seq, 'T', ''))) AS BIGINT) AS total FROM g"),
    "letter_complements": "SELECT letter, count(*) AS n, CASE letter WHEN 'A' THEN 'T' WHEN 'C' THEN 'G' WHEN 'G' THEN 'C' WHEN 'T' THEN 'A' ELSE 'N' END AS other FROM (SELECT unnest(string_split(translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), 'ACGTNRYSWKMBDHVUEFIJLOPQXZacgtnryswkmbdhvuefijlopqxz', 'ACGTNRYSWKMBDHVU          ACGTNRYSWKMBDHVU          '), '')) AS letter FROM documents) WHERE letter <> '' GROUP BY letter",
    "near_lengths": sql(f"SELECT {_ARR}, raw_length, CAST(CASE WHEN raw_length < {_NEAR} THEN 2 * ({_NEAR} - raw_length) - 1 WHEN raw_length < {2 * _NEAR} THEN 2 * (raw_length - {_NEAR}) ELSE raw_length END AS BIGINT) AS code, raw_length AS back FROM kd"),
    "shared_in_group_ids": sql(f"{_IDS} SELECT {_ARR}, key1, key2, in_group_id FROM ids"),
    "near_in_group_ids": sql(f"{_IDS} SELECT {_ARR}, key1, key2, in_group_id, CAST(CASE WHEN m IS NULL THEN in_group_id WHEN in_group_id = 0 THEN 0 WHEN in_group_id = m + 1 THEN 1 WHEN in_group_id < m + 1 THEN 2 * (m + 1 - in_group_id) WHEN in_group_id < 2 * (m + 1) THEN 2 * (in_group_id - m - 1) + 1 ELSE in_group_id + 1 END AS BIGINT) AS code FROM (SELECT *, max(CASE WHEN in_group_id > 0 THEN in_group_id END) OVER (PARTITION BY key1, key2 ORDER BY {_ARR} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ids)"),
    "candidate_order": sql(f"{_REFS} SELECT {_ARR}, key1, key2, row_number() OVER (PARTITION BY {_ARR} ORDER BY abs(raw_length - n), n, key1, key2) AS rank FROM (SELECT k.sample_ord, k.contig_ord, k.place, k.raw_length, rf.key1, rf.key2, length(ref) AS n FROM kd k JOIN rf ON coalesce(k.front, k.back) = rf.key1 OR coalesce(k.front, k.back) = rf.key2 WHERE k.has_front <> k.has_back)"),
    "kmer_ranks": kmers_sql("SELECT ck, row_number() OVER (ORDER BY ck) - 1 AS rank FROM (SELECT DISTINCT ck FROM ck WHERE sample_ord = 0)"),
    "reference_packing": sql(f"{_REFS} SELECT key1, key2, CAST(CASE WHEN s >= 0.5 THEN 0 ELSE 1 END AS INTEGER) AS kind, CAST(CASE WHEN s >= 0.5 THEN len(l) ELSE len(l) // 4 + 2 END AS BIGINT) AS size FROM (SELECT key1, key2, l, {_SIMILAR} AS s FROM (SELECT key1, key2, list_filter(string_split(ref, ''), lambda c: c <> '') AS l FROM rf))"),
    "lz_first_form": _lz_oracle(),
    "contig_name_steps": genome("SELECT sample_ord, contig_ord, contig_full FROM g"),
}
