"""Column functions on DNA and VCF text."""
