"""Sequence-family classification and a small set of dataframe verbs, as Spark queries."""
