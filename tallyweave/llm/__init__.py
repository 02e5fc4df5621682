"""Training-data operators: thirteen corpus operators, their driver queries and the corpus pipeline's building blocks.

Nothing else in the library imports this subpackage.
"""
