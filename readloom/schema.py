"""Schemas of alignments and of the results."""

ALIGNMENT = (
    "query_name string, reference string, reference_start bigint, reference_end bigint, is_reverse boolean, mapping_quality int, "
    "query_sequence string, query_length int, inferred_query_length int, inferred_read_length int, query_alignment_length int, "
    "nm int, as_score int, xo int, xg int, flag int, cigar string, raw binary"
)
REFERENCES = "reference string, bam_reference_length bigint, header_order int"
LENGTHS = "reference string, length bigint"
LCA_SUMMARY = ("taxid", "name", "rank", "n_reads", "abundance", "tax_path")

# The columns of the statistics table, in order.
REF_STATS = (
    "reference", "n_reads", "n_alns", "read_length_mean", "read_length_std", "read_length_min", "read_length_max", "read_length_median",
    "read_length_mode", "gc_content", "read_aligned_length", "read_aln_score", "mapping_quality", "edit_distances", "read_ani_mean",
    "read_ani_std", "read_ani_median", "bases_covered", "max_covered_bases", "mean_covered_bases", "coverage_mean", "coverage_mean_trunc",
    "coverage_mean_trunc_len", "coverage_covered_mean", "reference_length", "bam_reference_length", "breadth", "exp_breadth",
    "breadth_exp_ratio", "n_bins", "site_density", "entropy", "norm_entropy", "gini", "norm_gini", "c_v", "d_i", "cov_evenness",
    "tax_abund_read", "tax_abund_aln", "tax_abund_tad", "n_reads_tad",
)
