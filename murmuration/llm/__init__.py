"""Training-data operators: extraction, filtering, near duplicates, packing, search.

Nothing outside this subpackage imports it.
"""
