"""Training-data operators: language id, subword encoding, quality scoring, de-duplication, page
extraction, chat formatting and source mixing.

Each operator is a function ``DataFrame -> DataFrame`` in its own module; ``queries`` registers one
query per operator.  Nothing outside this subpackage imports it.
"""
