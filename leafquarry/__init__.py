"""Document catalogue, hybrid search and enrichment as DataFrame plans."""
