"""Training-data operators: scoring, filtering, deduplication, decontamination, mixing and token accounting.

Each module holds one operator with a general interface; ``queries`` applies
them to the shared tables. Nothing outside this folder imports it.
"""
