"""Training-data operators: encoding, archives, scans, search, fingerprints, dedup, packing, language ID.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
