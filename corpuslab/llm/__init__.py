"""Training-data operators: packing, chat formatting, search, joins, rules,
classifiers, archives, scoring and tokenising.

Nothing else in the library imports this subpackage.
"""
