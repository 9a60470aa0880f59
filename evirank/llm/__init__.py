"""Training-data operators: mixing, filtering, archiving and deduplicating text at corpus scale.

Every module holds one operator with its own general interface.  ``queries`` has the thin
``opN_<name>`` queries that apply them to the test tables.  Nothing outside this package imports it.
"""
