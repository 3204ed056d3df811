"""Operators for preparing training text at corpus scale.

Thirteen operators share this subpackage: exact vector search, substring and
near duplicate removal, packing, token counting, source mixing, URL and quality
filters, language identification, page text extraction, page archives, and
prefix tries and repair of conversations.  Each module holds
one operator with a general interface; `queries` turns them into the
registered `opN_*` queries.
"""
