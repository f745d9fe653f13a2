"""Corpus operators: deduplication, decontamination, redaction, filtering, sharding and tokenisation of document tables."""
