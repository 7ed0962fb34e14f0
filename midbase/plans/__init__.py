"""End-to-end plans: the SNP-mer caller and the workflows on its output."""
