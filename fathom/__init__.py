"""Document search, retrieval evaluation and corpus processing as DataFrame-to-DataFrame operators."""
