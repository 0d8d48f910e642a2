"""Training-data operators: quality, decontamination, deduplication, scoring, formatting, filtering,
search, mixing, sharding and extraction. Nothing outside this folder imports it."""
