"""Splitters, segments, keys, groups, partners, votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, grouping, kmers, segmentation
from ..sources.genome_view import K, SEGMENT_SIZE, contigs_of
from .folders import new_path, stored_in
from .kmer_queries import FRACTION
from .views import segments as sql
from .views import splitters as splitters_sql

LOW, HIGH = 120, 260


def _splitters(contigs):
    return segmentation.select_splitters(contigs.where("sample_ord = 0"), K, SEGMENT_SIZE)


def _segments(spark, d):
    c = contigs_of(spark, d)
    return segmentation.segments(c, _splitters(c), K)


def keyed_of(spark, d):
    c = contigs_of(spark, d)
    return segmentation.with_keys(segmentation.with_sequences(segmentation.segments(c, _splitters(c), K), c), K)


def splitters(spark, d):
    return _splitters(contigs_of(spark, d))


def splitter_hits(spark, d):
    """Where splitters occur, by the filter that is sent when they are many, and the join after it."""
    c = contigs_of(spark, d)
    values = stored_in(new_path(spark))(_splitters(c).select(kmers.kmer_value(F.col("ck"), K).alias("ck")), "splitters")  # read three times
    return kmers.maybe_windows_of(c, values, values.count(), K).join(values, "ck", "left_semi").select("sample_ord", "contig_ord", "end")


def segments(spark, d):
    return _segments(spark, d)


def segment_lengths(spark, d):
    return catalog.lengths_from_segments(_segments(spark, d), K)


def segments_for_range(spark, d):
    return grouping.for_range(_segments(spark, d), LOW, HIGH).select("sample_ord", "contig_ord", "place", "start", "raw_length")


def segment_keys(spark, d):
    return keyed_of(spark, d).select("sample_ord", "contig_ord", "place", "front", "back", "key1", "key2", "is_rev_comp")


def group_sizes(spark, d):
    return grouping.key_sizes(keyed_of(spark, d))


def groups_first_seen(spark, d):
    """Consecutive group ids in order of first arrival, after the raw groups."""
    first = grouping.first_seen(keyed_of(spark, d)).select("key1", "key2", "first.*")
    return grouping.numbered(first, list(grouping.ARRIVAL), grouping.RAW_GROUPS).select("group_id", "key1", "key2", "sample_ord", "contig_ord", "place")


def in_group_ordinal(spark, d):
    members = keyed_of(spark, d).where("key1 is not null").select(*grouping.ARRIVAL, "key1", "key2")
    return grouping.in_group_ordinals(members)


def raw_round_robin(spark, d):
    return grouping.raw_round_robin(keyed_of(spark, d))


def splitter_partners(spark, d):
    return grouping.partners(keyed_of(spark, d)).select("ck", F.array_join("partners", ",").alias("partners"))


def middle_candidates(spark, d):
    keyed = keyed_of(spark, d)
    pairs = keyed.where("front is not null and back is not null").select("front", "back").distinct()
    return grouping.middle_candidates(pairs, grouping.partners(keyed))


def _votes(spark, d, most=None):
    keep = stored_in(new_path(spark))
    c = keep(contigs_of(spark, d).select("sample_ord", "contig_ord", "seq"), "contigs")  # read many times
    found = segmentation.with_keys(segmentation.with_sequences(segmentation.segments(c, _splitters(c), K), c), K)
    # without letters: places and keys are all that votes need
    keyed = keep(found.select(*grouping.ARRIVAL, "start", "raw_length", "key1", "key2", "is_rev_comp"), "keyed")
    sampled = keep(kmers.sampled_codes(c, K, FRACTION), "sampled")
    return grouping.fallback_votes(sampled, keyed.where("key1 is null"), grouping.mapped_kmers(sampled, keyed, K), K, keep, most=most)


def fallback_votes(spark, d):
    return _votes(spark, d)


def fallback_top10(spark, d):
    return grouping.best_candidates(_votes(spark, d, most=10))


def adaptive_splitters(spark, d):
    keep = stored_in(new_path(spark))
    c = keep(contigs_of(spark, d).select("sample_ord", "contig_ord", "seq"), "contigs")  # read many times
    reference = c.where("sample_ord = 0")
    letters = {r["own"]: r["n"] or 0 for r in c.groupBy((F.col("sample_ord") == 0).alias("own")).agg(F.sum(F.char_length("seq")).alias("n")).collect()}
    known = keep(segmentation.select_splitters(reference, K, SEGMENT_SIZE, kmers.tasks_for(spark, letters.get(True))), "splitters")
    return segmentation.adaptive_splitters(c, known, reference, K, SEGMENT_SIZE, kmers.tasks_for(spark, sum(letters.values())))


QUERIES = {f.__name__: f for f in (splitters, splitter_hits, segments, segment_lengths, segments_for_range, segment_keys, group_sizes, groups_first_seen, in_group_ordinal, raw_round_robin, splitter_partners, middle_candidates, fallback_votes, fallback_top10, adaptive_splitters)}


def _sampled_part() -> str:
    from .kmer_queries import ORACLES as K_ORACLES

    q = K_ORACLES["sampled_kmers"]
    inner = q[q.index("v0 AS") :]
    views, select = inner[: inner.rindex(" SELECT ck FROM (SELECT ck, xor")], inner[inner.rindex("SELECT ck FROM (SELECT ck, xor") :]
    return f"{views}, smp AS ({select})"


_VOTES = (
    ", " + _sampled_part() + ", "
    "occ AS (SELECT c.* FROM ck c JOIN smp USING (ck) WHERE kmer <> translate(reverse(kmer), 'ACGT', 'TGCA')), "
    'inseg AS (SELECT o.ck, o.kmer = o.ck AS fwd, k.sample_ord, k.contig_ord, k.place, k.key1, k.key2, k.is_rev_comp FROM occ o JOIN kd k ON k.sample_ord = o.sample_ord AND k.contig_ord = o.contig_ord AND o."end" <= k.start + k.raw_length - 1 AND o."end" - 16 >= k.start), '
    "fm AS (SELECT DISTINCT ck, key1, key2, fwd <> is_rev_comp AS dir FROM inseg WHERE key1 IS NOT NULL), own AS (SELECT DISTINCT sample_ord, contig_ord, place, ck, fwd FROM inseg WHERE key1 IS NULL), "
    "votes AS (SELECT sample_ord, contig_ord, place, fm.key1, fm.key2, own.fwd <> fm.dir AS is_rev_comp, count(DISTINCT ck) AS votes FROM own JOIN fm USING (ck) GROUP BY ALL) "
)
_ARR = "sample_ord, contig_ord, place"

ORACLES = {
    "splitters": splitters_sql("SELECT ck FROM spl"),
    "splitter_hits": sql('SELECT sample_ord, contig_ord, e AS "end" FROM hit'),
    "segments": sql(f"SELECT {_ARR}, start, raw_length, has_front, has_back FROM sg"),
    "segment_lengths": sql(f"SELECT sample_ord, contig_ord, CAST(sum(raw_length) - (count(*) - 1) * {K} AS BIGINT) AS length, count(*) AS n_segments FROM sg GROUP BY ALL"),
    "segments_for_range": sql(f"SELECT {_ARR}, start, raw_length FROM sg WHERE start <= {HIGH} AND start + raw_length > {LOW}"),
    "segment_keys": sql(f"SELECT {_ARR}, front, back, key1, key2, is_rev_comp FROM kd"),
    "group_sizes": sql("SELECT key1, key2, count(*) AS n_segments FROM kd WHERE key1 IS NOT NULL GROUP BY ALL"),
    "groups_first_seen": sql(f"SELECT row_number() OVER (ORDER BY {_ARR}) + 15 AS group_id, key1, key2, {_ARR} FROM (SELECT *, row_number() OVER (PARTITION BY key1, key2 ORDER BY {_ARR}) AS r FROM kd WHERE key1 IS NOT NULL) WHERE r = 1"),
    "in_group_ordinal": sql(f"SELECT {_ARR}, key1, key2, row_number() OVER (PARTITION BY key1, key2 ORDER BY {_ARR}) - 1 AS in_group FROM kd WHERE key1 IS NOT NULL"),
    "raw_round_robin": sql(f"SELECT {_ARR}, CAST(CASE WHEN j >= n - ceil(n / 16.0) THEN 0 ELSE j % 15 + 1 END AS INTEGER) AS raw_group FROM (SELECT {_ARR}, row_number() OVER (PARTITION BY sample_ord ORDER BY contig_ord, place) - 1 AS j, count(*) OVER (PARTITION BY sample_ord) AS n FROM kd WHERE NOT has_front AND NOT has_back)"),
    "splitter_partners": sql("SELECT ck, string_agg(o, ',' ORDER BY o) AS partners FROM (SELECT key1 AS ck, key2 AS o FROM kd WHERE key1 IS NOT NULL UNION SELECT key2, key1 FROM kd WHERE key1 IS NOT NULL) GROUP BY ck"),
    "middle_candidates": sql(", pt AS (SELECT key1 AS ck, key2 AS o FROM kd WHERE key1 IS NOT NULL UNION SELECT key2, key1 FROM kd WHERE key1 IS NOT NULL) SELECT p.front, p.back, min(a.o) AS middle FROM (SELECT DISTINCT front, back FROM kd WHERE key1 IS NOT NULL) p JOIN pt a ON a.ck = p.front JOIN pt b ON b.ck = p.back AND b.o = a.o GROUP BY p.front, p.back"),
    "fallback_votes": sql(f"{_VOTES} SELECT {_ARR}, key1, key2, is_rev_comp, votes FROM votes"),
    "fallback_top10": sql(f"{_VOTES} SELECT {_ARR}, key1, key2, is_rev_comp, votes, rank FROM (SELECT *, row_number() OVER (PARTITION BY {_ARR} ORDER BY votes DESC, CASE WHEN is_rev_comp THEN key2 ELSE key1 END DESC, CASE WHEN is_rev_comp THEN key1 ELSE key2 END DESC) AS rank, max(votes) OVER (PARTITION BY {_ARR}) AS best FROM votes) WHERE rank <= 10 AND votes * 2 >= best"),
    "adaptive_splitters": sql(
        f", lng AS (SELECT g.sample_ord, g.contig_ord FROM g WHERE length(seq) >= {SEGMENT_SIZE} AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.sample_ord = g.sample_ord AND h.contig_ord = g.contig_ord)),"
        ' own AS (SELECT c.sample_ord, c.contig_ord, c.ck, min(c."end") AS e FROM ck c JOIN lng USING (sample_ord, contig_ord) GROUP BY ALL HAVING count(*) = 1),'
        " nw AS (SELECT * FROM own WHERE ck NOT IN (SELECT ck FROM ck WHERE sample_ord = 0)),"
        f" pk AS (SELECT sample_ord, contig_ord, min(e) AS e FROM nw GROUP BY ALL UNION ALL SELECT p.sample_ord, p.contig_ord, (SELECT min(n.e) FROM nw n WHERE n.sample_ord = p.sample_ord AND n.contig_ord = p.contig_ord AND n.e >= p.e + {SEGMENT_SIZE}) FROM pk p WHERE p.e IS NOT NULL),"
        " tk AS (SELECT * FROM pk WHERE e IS NOT NULL),"
        f" al AS (SELECT * FROM tk UNION SELECT t.sample_ord, t.contig_ord, t.e FROM (SELECT sample_ord, contig_ord, max(e) AS e FROM nw GROUP BY ALL) t JOIN (SELECT sample_ord, contig_ord, max(e) AS m FROM tk GROUP BY ALL) x USING (sample_ord, contig_ord) WHERE t.e >= x.m + {K})"
        " SELECT DISTINCT nw.ck FROM nw JOIN al USING (sample_ord, contig_ord, e)"
    ),
}
