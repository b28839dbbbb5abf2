"""Training-data operators (HTML extraction, near-dedup, toxicity, language
ID, ANN, line dedup, binary token output, quality rules, packing, BPE).

The rest of the library does not import this subpackage.
"""
