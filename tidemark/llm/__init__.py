"""Training-data operators: quality, tokens, mixing, privacy, duplicates, placement.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is there.
"""
