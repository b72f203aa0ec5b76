"""Operations on training text at scale: deduplication, tokenizing, filtering, formatting, packing and search.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
