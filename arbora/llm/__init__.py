"""Training-data operators: packing, filtering, de-duplication, search, archives and extraction.

Nothing outside this package imports it.  Each module holds one operator with a general interface;
``queries.py`` holds the thin ``opN_<name>`` queries over the test tables.
"""
