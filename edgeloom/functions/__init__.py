"""Column functions: hashes, coins and distinct-count sketches."""
