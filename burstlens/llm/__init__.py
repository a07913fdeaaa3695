"""Training-data operators: deduplication, quality, secrets, language,
tokenisation, search, sharding and packing, each on plain DataFrames.

Every operator takes a DataFrame (and the names of its id and text columns),
selects what it needs at once, so extra columns never clash, and returns a
DataFrame.  ``queries.py`` holds the thin registered queries.
"""
