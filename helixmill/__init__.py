"""Spark jobs over corpora of RNA sequences and their secondary structures."""
