"""Column builders for sequences, names and queries. All are built-in expressions that stay in the JVM."""

from .names import contig_query, normalised_range, sample_name, short_name, slice_range
from .sequences import (
    base64_name,
    base_sum,
    canonical,
    complement,
    dna_code,
    dna_view,
    fasta_record,
    hex_name,
    is_forward,
    is_sampled,
    is_valid_kmer,
    iupac_view,
    kmer_value,
    n_runs,
    normalise_symbols,
    reverse_complement,
    self_similarity,
    with_fmix64,
    wrap,
    zigzag,
)

__all__ = [
    "base64_name", "base_sum", "canonical", "complement", "contig_query", "dna_code", "dna_view", "fasta_record", "hex_name", "is_forward", "is_sampled", "is_valid_kmer", "iupac_view",
    "kmer_value", "n_runs", "normalise_symbols", "normalised_range", "reverse_complement", "sample_name", "self_similarity", "short_name",
    "slice_range", "with_fmix64", "wrap", "zigzag",
]
