"""Codec, archive round trips, and cost arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codec, grouping
from ..operators.archive import Collection, cheapest_groups, through_middle
from ..sources.genome_view import K, MIN_MATCH, SEGMENT_SIZE, contigs_of
from .folders import new_path, stored_in
from .segment_queries import keyed_of
from .views import genome

#: Collections made in this process, by application and input.
_made: dict[tuple[str, str], str] = {}


def _created(spark, d):
    """The collection over the genome view; once made, it is opened again by every query of the session."""
    key = spark.sparkContext.applicationId, d
    if key not in _made:
        _made[key] = Collection.create(contigs_of(spark, d), new_path(spark), k=K, segment_size=SEGMENT_SIZE, min_match=MIN_MATCH).path
    return Collection(spark, _made[key])


def kept_keyed(spark, d):
    """Keyed segments, made once and stored, for queries that read them more than once."""
    return stored_in(new_path(spark))(keyed_of(spark, d), "keyed")


def with_references(spark, d, keyed=None):
    """Keyed segments in their group's direction as ``body``, with the first arrival's letters as ``ref_seq``. ``keyed``: the
    stored segments, where the caller has them."""
    from ..functions import reverse_complement

    keyed = (kept_keyed(spark, d) if keyed is None else keyed).where("key1 is not null")
    members = keyed.select(*grouping.ARRIVAL, "key1", "key2", F.when(F.col("is_rev_comp"), reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("body"))
    first = members.groupBy("key1", "key2").agg(F.min(F.struct(*grouping.ARRIVAL, "body")).alias("m")).select("key1", "key2", F.col("m.body").alias("ref_seq"))
    return members.join(first, ["key1", "key2"]).sortWithinPartitions("key1", "key2")


def lz_roundtrip(spark, d):
    """Segments coded against their group's reference and decoded again."""
    rows = with_references(spark, d)
    coded = codec.encode_rows(rows.withColumn("ref2", F.col("ref_seq")), MIN_MATCH).withColumnRenamed("ref2", "ref_seq")
    return codec.decode_rows(coded, MIN_MATCH).select(*grouping.ARRIVAL, F.col("body").alias("seq"))


def lz_token_stats(spark, d):
    coded = codec.encode_rows(with_references(spark, d), MIN_MATCH)
    return codec.token_statistics(coded.select(*grouping.ARRIVAL, "body"))


def best_group_one_splitter(spark, d):
    keep = stored_in(new_path(spark))
    keyed = keep(keyed_of(spark, d), "keyed")
    refs = with_references(spark, d, keyed).groupBy("key1", "key2").agg(F.min("sample_ord").alias("first_sample"), F.first("ref_seq").alias("ref_seq"))
    return cheapest_groups(keyed.where("(front is null) <> (back is null)"), keep(refs, "references"), MIN_MATCH, keep)


def bridged(spark, d):
    """Segments with two k-mers, and all groups, by two of which such a segment may be bridged."""
    keep = stored_in(new_path(spark))
    keyed = keep(keyed_of(spark, d), "keyed")
    return keyed.where("key1 is not null"), keep(with_references(spark, d, keyed).select("key1", "key2", "ref_seq").distinct(), "references")


def bridged_splits(spark, d):
    """Where segments between two groups are cut, by the costs of every letter against both references."""
    return through_middle(*bridged(spark, d), K, MIN_MATCH)


def groups_in_rounds(spark, d):
    """Pairs of splitters that open a group, with the sample that does: those that no two groups of earlier samples bridge."""
    pairs = keyed_of(spark, d).where("key1 is not null").groupBy("key1", "key2").agg(F.min("sample_ord").alias("round"))
    keep = stored_in(new_path(spark))
    pairs = keep(pairs, "pairs")
    return grouping.opened_in_rounds(pairs.where("round > 0"), pairs.where("round = 0"), keep)


def archive_roundtrip(spark, d):
    return _created(spark, d).get_collection()


def archive_range(spark, d):
    """Letters 100 to 220 of every contig, decoded from the segments that hold them."""
    return _created(spark, d).contigs_with_sequences(low=100, high=220).select("sample", "contig", "seq")


def archive_lengths(spark, d):
    return _created(spark, d).contigs().select("sample", "contig", "length")


def archive_sizes(spark, d):
    return _created(spark, d).sizes()


def archive_info(spark, d):
    return _created(spark, d).info().drop("commands")


def append_equals_create(spark, d):
    """Half of the samples created, the rest appended: the same contigs."""
    c = stored_in(new_path(spark))(contigs_of(spark, d), "contigs")  # both calls read it
    made = Collection.create(c.where("sample_ord < 10"), new_path(spark), k=K, segment_size=SEGMENT_SIZE, min_match=MIN_MATCH)
    return made.append(c.where("sample_ord >= 10")).get_collection()


def append_two_handles(spark, d):
    """A collection to which two handles that do not know of each other append: nothing is lost."""
    c = stored_in(new_path(spark))(contigs_of(spark, d), "contigs")  # all calls read it
    one = Collection.create(c.where("sample_ord < 10"), new_path(spark), k=K, segment_size=SEGMENT_SIZE, min_match=MIN_MATCH)
    two = Collection(spark, one.path)
    one.append(c.where("sample_ord between 10 and 14"))
    return two.append(c.where("sample_ord > 14")).get_collection()


def collection_from_parts(spark, d):
    """A collection made of contigs that come in parts of at most 300 letters."""
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.char_length("seq") - 1, F.lit(0)), F.lit(300)))
    cut = contigs_of(spark, d).withColumn("offset", at)
    parts = cut.select("sample_ord", "sample", "contig_ord", "contig", "contig_full", F.col("offset").cast("long").alias("offset"), F.substring("seq", F.col("offset") + 1, F.lit(300)).alias("part"))
    return Collection.create(parts, new_path(spark), k=K, segment_size=SEGMENT_SIZE, min_match=MIN_MATCH).get_collection()


def adaptive_roundtrip(spark, d):
    made = Collection.create(contigs_of(spark, d), new_path(spark), k=K, segment_size=SEGMENT_SIZE, min_match=MIN_MATCH, adaptive=True)
    return made.get_collection()


def fallback_roundtrip(spark, d):
    """With sampled k-mers voting for groups."""
    made = Collection.create(contigs_of(spark, d), new_path(spark), k=K, segment_size=SEGMENT_SIZE, min_match=MIN_MATCH, fallback=0.05)
    return made.get_collection()


def getset_archive(spark, d):
    """Samples of a stored collection in argument order, repeated ones twice."""
    return _created(spark, d).get_samples(["src3", "src0", "src3"]).select("argument", "contig_ord", "contig_full", "seq")


def getctg_archive(spark, d):
    """Contig queries of every form against a stored collection."""
    return _created(spark, d).get_contigs(_ASKED)


_ASKED = ["doc7", "doc7@src0", "doc12:5-40", "doc12:30-", "nosuch", "doc3:-4-9", "", "doc21:100-20", "doc30:9000-9100"]


def _costs(spark, d):
    """Cost arrays of every contig: letters that cost something on the left and on the right."""
    c = contigs_of(spark, d).select("contig", F.split("seq", "").alias("letters"))
    pick = lambda wanted: F.transform(F.filter("letters", lambda x: x != ""), lambda x: F.when(x.isin(*wanted), 3).otherwise(1).cast("long"))
    return c.select(F.col("contig").alias("id"), pick("AC").alias("cost1"), pick("GT").alias("cost2")).where(F.size("cost1") > 0)


def coding_cost_prefix(spark, d):
    each = _costs(spark, d).select("id", F.posexplode("cost1").alias("at", "cost"))
    from pyspark.sql import Window

    order = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("id", F.col("at").cast("long").alias("at_"), F.sum("cost").over(order).alias("upto"))


def best_split(spark, d):
    return grouping.best_split(_costs(spark, d), K)


QUERIES = {f.__name__: f for f in (lz_roundtrip, lz_token_stats, best_group_one_splitter, bridged_splits, groups_in_rounds, archive_roundtrip, archive_range, archive_lengths, archive_sizes, archive_info, append_equals_create, append_two_handles, collection_from_parts, adaptive_roundtrip, fallback_roundtrip, getset_archive, getctg_archive, coding_cost_prefix, best_split)}

_LETTERS = "l AS (SELECT contig AS id, i - 1 AS pos, CASE WHEN substr(seq, i, 1) IN ('A', 'C') THEN 3 ELSE 1 END AS c1, CASE WHEN substr(seq, i, 1) IN ('G', 'T') THEN 3 ELSE 1 END AS c2, length(seq) AS n FROM (SELECT contig, seq, unnest(range(1, length(seq) + 1)) AS i FROM g))"
_PARSED = """a AS (SELECT * FROM (VALUES (0, 'doc7', '', -1, -1), (1, 'doc7', 'src0', -1, -1), (2, 'doc12', '', 5, 40), (3, 'doc12:30-', '', -1, -1), (4, 'nosuch', '', -1, -1),
 (5, 'doc3', '', -4, 9), (7, 'doc21', '', 100, 20), (8, 'doc30', '', 9000, 9100)) AS v(query_ord, contig, sample, f, t))"""
_COLLECTION = genome("SELECT sample_ord, contig_ord, contig_full, seq FROM g")

ORACLES = {
    "archive_roundtrip": _COLLECTION,
    "append_equals_create": _COLLECTION,
    "append_two_handles": _COLLECTION,
    "collection_from_parts": _COLLECTION,
    "adaptive_roundtrip": _COLLECTION,
    "fallback_roundtrip": _COLLECTION,
    "getset_archive": genome("SELECT v.argument, g.contig_ord, g.contig_full, g.seq FROM (VALUES (0, 'src3'), (1, 'src0'), (2, 'src3')) AS v(argument, sample) JOIN g USING (sample)"),
    "getctg_archive": genome(f", {_PARSED}, q AS (SELECT a.*, count(g.contig) OVER (PARTITION BY query_ord) AS n, row_number() OVER (PARTITION BY query_ord ORDER BY sample_ord, contig_ord) AS r, g.contig_full, g.seq FROM a LEFT JOIN g ON g.contig = a.contig AND (a.sample = '' OR a.sample = g.sample)), z AS (SELECT *, CASE WHEN f < 0 THEN 0 ELSE f END AS lo, CASE WHEN t < 0 THEN 9000000000000000 ELSE t END AS hi FROM q WHERE r = 1) SELECT query_ord, CASE WHEN f < 0 AND t < 0 THEN contig_full ELSE contig_full || ':' || f || '-' || t END AS header, CAST(CASE WHEN n = 0 THEN -1 WHEN sample = '' AND n > 1 THEN -2 ELSE 0 END AS INTEGER) AS status, CASE WHEN n = 0 OR (sample = '' AND n > 1) THEN NULL WHEN lo > hi THEN seq ELSE substr(seq, lo + 1, greatest(least(hi, length(seq)) - lo + 1, 0)) END AS seq FROM z"),
    "archive_range": genome("SELECT sample, contig, substr(seq, 101, 121) AS seq FROM g"),
    "archive_lengths": genome("SELECT sample, contig, length(seq) AS length FROM g"),
    "archive_info": genome(f"SELECT count(*) AS n_contigs, CAST(sum(length(seq)) AS BIGINT) AS n_letters, count(DISTINCT sample) AS n_samples, max(CASE WHEN sample_ord = 0 THEN sample END) AS reference, CAST({K} AS INTEGER) AS k, CAST({MIN_MATCH} AS INTEGER) AS min_match, CAST({SEGMENT_SIZE} AS INTEGER) AS segment_size, CAST(50 AS INTEGER) AS pack_cardinality, CAST(0 AS DOUBLE) AS fallback, false AS concatenated FROM g"),
    "coding_cost_prefix": genome(f", {_LETTERS} SELECT id, pos AS at_, CAST(sum(c1) OVER (PARTITION BY id ORDER BY pos) AS BIGINT) AS upto FROM l"),
    "best_split": genome(f", {_LETTERS}, b AS (SELECT id, pos, n, sum(c1) OVER (PARTITION BY id ORDER BY pos) + sum(c2) OVER (PARTITION BY id ORDER BY pos DESC) AS s FROM l), m AS (SELECT id, any_value(n) AS n, CAST(min(s) AS BIGINT) AS cost, arg_min(pos, (s, pos)) AS pos FROM b GROUP BY id) SELECT id, cost, CASE WHEN pos < {K + 1} THEN 0 WHEN pos + {K + 1} > n THEN n ELSE pos END AS split FROM m"),
}


def _lz_oracle() -> str:
    from .views import segments as sql

    return sql("SELECT sample_ord, contig_ord, place, CASE WHEN is_rev_comp THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq FROM kd WHERE key1 IS NOT NULL")


ORACLES["lz_roundtrip"] = _lz_oracle()


def _rounds_oracle() -> str:
    """Round after round, carrying all groups that are open."""
    from .views import segments as sql

    ends = "(SELECT key1 AS ck, key2 AS o FROM rec UNION SELECT key2, key1 FROM rec)"
    return sql(f""", pr AS (SELECT key1, key2, CAST(min(sample_ord) AS INTEGER) AS r FROM kd WHERE key1 IS NOT NULL GROUP BY key1, key2)
SELECT key1, key2, r AS round FROM (WITH RECURSIVE rec AS (SELECT 0 AS step, key1, key2, r FROM pr WHERE r = 0 UNION ALL (
 SELECT step + 1, key1, key2, r FROM rec WHERE step < (SELECT max(r) FROM pr)
 UNION ALL SELECT p.r, p.key1, p.key2, p.r FROM pr p JOIN (SELECT DISTINCT step + 1 AS now FROM rec) t ON p.r = t.now
 LEFT JOIN (SELECT DISTINCT q.key1, q.key2 FROM pr q JOIN {ends} a ON a.ck = q.key1 JOIN {ends} b ON b.ck = q.key2 AND b.o = a.o WHERE q.key1 <> q.key2) x ON x.key1 = p.key1 AND x.key2 = p.key2 WHERE x.key1 IS NULL
)) SELECT * FROM rec WHERE step = (SELECT max(r) FROM pr)) WHERE r > 0""")


ORACLES["groups_in_rounds"] = _rounds_oracle()
