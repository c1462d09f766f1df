"""Training-data operators: scans, filters, near-duplicates, tokens and archives."""
