"""Training-data operators: deduplication, scoring, formatting, search and mixing over text corpora.

Nothing else in the library imports this package.  Each module holds one operator with a general interface;
:mod:`faultline.llm.queries` binds them to the standard tables.
"""
