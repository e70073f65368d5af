"""Training-data operators over text, page and vector tables.

Nothing outside this subpackage imports it; `queries.py` holds the registered queries.
"""
