"""Knowledge-base retrieval and operational analytics as PySpark DataFrame plans."""
