"""Corpus operators for training-data pipelines.

Nothing else in the library imports this subpackage; ``queries.py`` registers
one ``opN_<name>`` query per operator.
"""
