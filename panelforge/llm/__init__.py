"""Operators for large text corpora: decontamination, tokenizer, language-model
scoring, near-duplicates, chat formatting, secret scans, toxicity, fingerprints
and quality.  Queries are registered in :mod:`panelforge.llm.queries`; nothing
else in the library imports this package."""
