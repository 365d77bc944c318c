"""Operators for large training-text pipelines: scoring, packing, placement, scans, de-duplication, decontamination."""
