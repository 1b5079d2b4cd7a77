"""Evidence analytics expressed as Spark DataFrame transformations.

Every operator is a pure ``DataFrame -> DataFrame`` function without an action
inside; see README.md for the map of operators.
"""
