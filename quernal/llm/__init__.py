"""Training-data operators: dedup, licence lookup, extraction, quality, language, mixing, toxicity, secrets, decontamination.

Nothing else in the library imports this subpackage.
"""
