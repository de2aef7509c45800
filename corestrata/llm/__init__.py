"""Training-data operators: token counts, pseudonyms, near and exact dedup, secret scans, archives, packing, quality."""
