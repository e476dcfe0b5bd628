"""Operators of a training-data pipeline over ``documents`` and ``pages``.

One module per operator, each a plain ``DataFrame -> DataFrame`` function; ``queries`` registers
one ``opN_<name>`` query per operator with its production parameters.
"""
