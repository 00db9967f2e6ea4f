"""Record schemas of the file formats."""

from __future__ import annotations

FASTA = "id bigint, name string, description string, sequence string, file string, offset bigint"
FASTQ = "id bigint, name string, description string, sequence string, quality string, file string"
BAM = (
    "id bigint, primary_id bigint, name string, flag int, ref_id int, pos int, mapq int, next_ref_id int, next_pos int, "
    "tlen int, sequence string, quality binary, nm int, as_score int, file string"
)
BAM_REFS = "ref_id int, name string, length int"
FAIDX = "name string, length bigint, offset bigint, line_bases bigint, line_width bigint, description string"
KMC = "kmer string, count bigint"
KMC_HEADER = (
    "kmer_length bigint, mode bigint, counter_size bigint, lut_prefix_length bigint, signature_length bigint, "
    "min_count bigint, max_count bigint, total_kmers bigint, both_strands boolean, version bigint"
)
