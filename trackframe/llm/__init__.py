"""Operators for preparing training text at scale.

Nothing outside this folder imports it.  Each module holds one operator with
its own DataFrame interface; ``queries`` registers thin queries over the
tables and ``sql`` their SQL where SQL can express them.
"""
