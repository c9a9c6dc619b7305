"""Training-data operators: extraction, cleaning, deduplication, packing and token output.

Self-contained: nothing outside this subpackage imports it. Each module holds
one operator with a general interface; ``queries`` derives the registered
digest queries from them.
"""
