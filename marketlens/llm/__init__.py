"""Training-data operators: ten self-contained modules over documents, pages and vectors.

Nothing else in the library imports this subpackage.
"""
