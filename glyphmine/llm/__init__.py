"""Training-data operators: deduplication, filtering, scoring, mixing and packing of text corpora.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
