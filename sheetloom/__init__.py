"""Evidence-graph analytics over page-level documents, as Spark plans."""
