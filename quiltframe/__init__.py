"""Table profiling, cleaning, deduplication, quality, privacy and synthesis on Spark."""
