"""Training-data operators (deduplication, filtering, mixing, packing, scoring).

Self-contained: nothing outside this package imports it.  ``catalogue`` holds
the registered queries, ``oracle`` their DuckDB SQL where SQL can express them.
"""
