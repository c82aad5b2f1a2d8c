"""Evidence-history analytics on Spark: retrieval, ledgers, governance and evaluation as DataFrame plans."""
