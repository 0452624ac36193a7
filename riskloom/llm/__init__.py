"""Training-data operators: dedup, scans, tokenisation, packing (nothing else in the library imports this package)."""
