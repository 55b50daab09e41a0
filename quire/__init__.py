"""quire: document-optimisation analytics expressed as Spark plans."""
