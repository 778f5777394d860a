"""Operators for preparing language-model training data; nothing outside this folder imports it.

Every operator takes DataFrames, reads the columns it names and no others (extra
columns, whatever their names, do not disturb it), and says in its docstring what
nulls, empty texts, repeated rows and empty tables give.
"""
