"""Training-data operators: sharding, deduplication, tokenising, filtering, search, scoring, mixing.

Nothing outside this folder imports it; ``registry`` lists the queries it offers.
"""
