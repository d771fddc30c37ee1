"""Sources and sinks: FASTA text, file lists, and the genome view of the driver tables."""
