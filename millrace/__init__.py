"""millrace: text-to-token data preparation as PySpark DataFrame jobs."""
