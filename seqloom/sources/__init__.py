"""Readers and writers of sequence and annotation formats."""

from seqloom.sources.bam import read_bam
from seqloom.sources.detect import detect, read, sniff
from seqloom.sources.readers import hmm_summary, quality_offset, read_accessions, read_assembly_summary, read_bed, read_coverage, read_fasta, read_fastq, read_genbank, read_gfa, read_gfa_links, read_gff, read_gi_table, read_histogram, read_hmm_report, read_matrix, read_names, read_names_table, read_oneline, read_phylip, read_qual, read_sam, read_scarf, read_taxonomy, read_vcf, twin_path
from seqloom.sources.writers import write, write_bed, write_fasta, write_fastq, write_gff, write_sam, write_stats_json, write_vcf

__all__ = [
    "detect", "hmm_summary", "quality_offset", "read", "read_accessions", "read_assembly_summary", "read_bam", "read_bed", "read_coverage", "read_fasta", "read_fastq", "read_genbank", "read_gfa", "read_gfa_links", "read_gff", "read_gi_table", "read_histogram", "read_hmm_report", "read_matrix", "read_names", "read_names_table", "read_oneline", "read_phylip", "read_qual", "read_sam", "read_scarf", "read_taxonomy", "read_vcf", "sniff", "twin_path", "write", "write_bed", "write_fasta", "write_fastq", "write_gff", "write_sam", "write_stats_json", "write_vcf",
]
