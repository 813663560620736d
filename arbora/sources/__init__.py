"""Readers and writers: delimited and JSON-lines records, archives, score tables, manifests."""
