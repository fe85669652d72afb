"""PDF files in plain Python: no Spark in here, one document at a time, all work bounded by its bytes."""
