"""PySpark operators for genomic intervals, single-cell coverage and corpus preparation."""
