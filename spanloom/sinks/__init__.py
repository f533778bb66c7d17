"""Writers of matrices, value tables and ordered regions."""
