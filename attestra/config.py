"""Constants that change results, in one place."""

CHUNK_TOKENS, CHUNK_OVERLAP, CHUNK_HARD_LIMIT = 800, 120, 896
DENSE_K = SPARSE_K = 24
FUSION_CANDIDATES, RRF_K, MMR_LAMBDA = 32, 60, 0.7
PAPER_HITS, COMMON_HITS = 8, 4
CONTEXT_BUDGET = 36_000
WORDS_PER_URL = 25
MIN_TEXT_CHARS = 1000
PACKET_WINDOW, PACKET_STRIDE = 1400, 1100
CLAIM_TOTAL, CLAIM_PER_CELL = 12, 2
