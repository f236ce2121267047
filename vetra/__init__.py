"""vetra: evidence-based screening and corpus analytics expressed as Spark DataFrame plans."""
