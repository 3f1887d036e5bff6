"""Training-data operators: filtering, classification, search, deduplication, tokenising, packing.

Nothing outside this folder imports it; of the rest it imports only what ships the code to Python workers.
"""
