"""Rule patterns, word lists, lookup tables and message texts.

Nothing here is logic.  Every table is a plain literal so that it can be read,
reviewed and replaced by a user table of the same shape.
"""
