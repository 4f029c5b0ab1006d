"""Training-data operators: licence scan, near-dedup, LM scoring, decontamination,
mixing, language id, HTML extraction, PII, quality rules and secret scans.

Nothing outside this package imports it.
"""
