"""Siltstone: document collections with filters, links, ranked text, vectors and versions, as Spark plans."""
