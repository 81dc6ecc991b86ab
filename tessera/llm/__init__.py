"""Training-data operators: dedup, decontamination, PII, URL filters, tokenisers,
language identification and HTML extraction, each as DataFrame -> DataFrame.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
