"""Training-data operators: media columns, dedup, classifiers, search, joins, tokens, packing, language.

Nothing else in the library imports this subpackage.
"""
