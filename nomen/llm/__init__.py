"""Operators of a training-data pipeline over ``documents`` and ``pages``.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries`` registers one thin
``opN_<name>`` query per operator.
"""
