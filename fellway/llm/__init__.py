"""Training-data operators: ten corpus operators and their registered queries.

Nothing outside this package imports it; ``__spark_entry__`` registers its
queries only when the package is present.
"""
