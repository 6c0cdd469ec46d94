"""Operators for preparing training text: quality rules, URL templates, BPE,
toxicity, source mixing, HTML extraction, nearest neighbours, token counts,
similarity join and language-model quality. Nothing outside this subpackage
(and ``corpus_pipeline.py``) imports it."""
