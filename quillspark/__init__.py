"""Document analytics on Spark: layout, fields, sections, retrieval, OCR scoring and evaluation as DataFrame plans."""
