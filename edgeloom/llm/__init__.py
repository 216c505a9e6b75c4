"""Operators for training-data pipelines. Nothing else in the library imports this subpackage.

Common rules, unless an operator says otherwise: rows are taken as they are (null, repeated and tied ids stay), a null text
counts as empty, columns that an operator does not name are not looked at, and an empty table gives an empty result.
"""
