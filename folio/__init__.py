"""folio: document-corpus analytics on PySpark DataFrames."""
