"""Training-data operators: ten numbered operators and the pipeline stages built from them.

Nothing outside this subpackage imports it.
"""
