"""Training-data operators: deduplication, decontamination, classifiers,
personal data, tokenisation. Nothing outside this subpackage imports it."""
