"""SQL of the genome view, shared by the oracles."""

from __future__ import annotations

from ..sources.genome_view import K, SEGMENT_SIZE

GENOME = """
s AS (SELECT source AS sample, CAST(row_number() OVER (ORDER BY min(doc_id)) - 1 AS INTEGER) AS sample_ord FROM documents GROUP BY source),
g AS (SELECT s.sample_ord, d.source AS sample, CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1 AS INTEGER) AS contig_ord,
  'doc' || d.doc_id AS contig, 'doc' || d.doc_id || ' ' || d.lang AS contig_full,
  regexp_replace(translate(d.text, 'acgt', 'ACGT'), '[^ACGT]', '', 'g') AS seq FROM documents d JOIN s ON s.sample = d.source)"""

KMERS = f"""
w AS (SELECT sample_ord, contig_ord, unnest(range({K - 1}, length(seq))) AS "end", seq FROM g),
km AS (SELECT sample_ord, contig_ord, "end", substr(seq, "end" - {K} + 2, {K}) AS kmer FROM w),
ck AS (SELECT *, least(kmer, translate(reverse(kmer), 'ACGT', 'TGCA')) AS ck FROM km)"""

SPLITTERS = f"""
cand AS (SELECT ck, any_value(contig_ord) AS contig_ord, any_value("end") AS e FROM ck WHERE sample_ord = 0 GROUP BY ck HAVING count(*) = 1),
pick AS (SELECT contig_ord, min(e) AS e FROM cand GROUP BY contig_ord
  UNION ALL SELECT p.contig_ord, (SELECT min(c.e) FROM cand c WHERE c.contig_ord = p.contig_ord AND c.e >= p.e + {SEGMENT_SIZE}) AS e FROM pick p WHERE p.e IS NOT NULL),
taken AS (SELECT contig_ord, e FROM pick WHERE e IS NOT NULL),
tail AS (SELECT c.contig_ord, max(c.e) AS e FROM cand c GROUP BY c.contig_ord),
accepted AS (SELECT * FROM taken UNION SELECT t.contig_ord, t.e FROM tail t JOIN (SELECT contig_ord, max(e) AS m FROM taken GROUP BY contig_ord) x USING (contig_ord) WHERE t.e >= x.m + {K}),
spl AS (SELECT DISTINCT c.ck FROM cand c JOIN accepted a ON a.contig_ord = c.contig_ord AND a.e = c.e)"""

SEGMENTS = f"""
hit AS (SELECT sample_ord, contig_ord, "end" AS e FROM ck WHERE ck IN (SELECT ck FROM spl)),
cutp AS (SELECT sample_ord, contig_ord, min(e) AS e FROM hit GROUP BY ALL
  UNION ALL SELECT p.sample_ord, p.contig_ord, (SELECT min(h.e) FROM hit h WHERE h.sample_ord = p.sample_ord AND h.contig_ord = p.contig_ord AND h.e >= p.e + {K}) AS e FROM cutp p WHERE p.e IS NOT NULL),
cuts AS (SELECT sample_ord, contig_ord, e, row_number() OVER (PARTITION BY sample_ord, contig_ord ORDER BY e) AS i FROM cutp WHERE e IS NOT NULL),
edge AS (SELECT sample_ord, contig_ord, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS e FROM g WHERE length(seq) > 0 UNION ALL SELECT sample_ord, contig_ord, i, e FROM cuts),
seg AS (SELECT x.sample_ord, x.contig_ord, CAST(x.i AS INTEGER) AS place, CASE WHEN x.i = 0 THEN 0 ELSE x.e + 1 - {K} END AS start,
  coalesce(y.e, length(g.seq) - 1) AS last, x.i > 0 AS has_front, y.e IS NOT NULL AS has_back, g.seq AS whole
  FROM edge x LEFT JOIN cuts y ON y.sample_ord = x.sample_ord AND y.contig_ord = x.contig_ord AND y.i = x.i + 1
  JOIN g ON g.sample_ord = x.sample_ord AND g.contig_ord = x.contig_ord),
sg AS (SELECT sample_ord, contig_ord, place, CAST(start AS BIGINT) AS start, CAST(last - start + 1 AS BIGINT) AS raw_length, has_front, has_back,
  substr(whole, start + 1, last - start + 1) AS seq FROM seg),
ends AS (SELECT *, CASE WHEN has_front THEN least(substr(seq, 1, {K}), translate(reverse(substr(seq, 1, {K})), 'ACGT', 'TGCA')) END AS front,
  CASE WHEN has_back THEN least(right(seq, {K}), translate(reverse(right(seq, {K})), 'ACGT', 'TGCA')) END AS back FROM sg),
kd AS (SELECT *, CASE WHEN has_front AND has_back THEN least(front, back) END AS key1, CASE WHEN has_front AND has_back THEN greatest(front, back) END AS key2,
  coalesce(has_front AND has_back AND NOT (front < back), false) AS is_rev_comp FROM ends)"""


def genome(select: str) -> str:
    return f"WITH {GENOME} {select}"


def kmers(select: str) -> str:
    return f"WITH {GENOME}, {KMERS} {select}"


def splitters(select: str) -> str:
    return f"WITH RECURSIVE {GENOME}, {KMERS}, {SPLITTERS} {select}"


def segments(select: str) -> str:
    return f"WITH RECURSIVE {GENOME}, {KMERS}, {SPLITTERS}, {SEGMENTS} {select}"
