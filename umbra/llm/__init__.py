"""Training-data operators: cleaning, deduplication, scoring, mixing and tokenizing of text tables.

Every operator reads only the columns it names, so further columns of an input never clash with
what it adds. Nothing else in the library imports this subpackage.
"""
