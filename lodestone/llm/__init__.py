"""Training-data operators: language ID, deduplication, scans, placement, counting, search and BPE.

Nothing outside this package imports it; `__spark_entry__.py` adds its queries when it is there.
"""
