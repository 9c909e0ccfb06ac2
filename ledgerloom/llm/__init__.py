"""Training-data operators: archives, de-duplication, decontamination, packing, search, scoring.

Each module holds one operator with a general DataFrame interface; ``queries`` registers the
thin ``opN_*`` queries over the driver tables.  Nothing outside this subpackage imports it.
"""
