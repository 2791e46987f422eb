"""Operations for large text corpora: token counts, archives, similarity joins, filters and language models.

Nothing outside this subpackage imports it.  The queries live in
:mod:`maskflow.llm.queries`.
"""
