"""Operators of a training-data pipeline over tables of documents.

Nothing else in the package imports this folder. Every operator takes a
DataFrame and the names of its id and text columns, reads only those, and
returns only its own columns, so further columns of the input never clash.
A null text counts as an empty one; rows with a null or repeated id each keep
a row of their own unless the operator says otherwise.
"""
