"""Constants of the scoring and curation operators, as plain values that any call may override."""

from __future__ import annotations

# The label domain, its ids and the order in which classes are reported.
LABELS = ("negatif", "netral", "positif")
LABEL_IDS = {"negatif": 0, "netral": 1, "positif": 2}
TOPIC_ORDER = ("positif", "netral", "negatif")

# The lexicon engine's scale, thresholds and clause weights.
MAX_ABS, NEGATION_SHIFT, NEGATIVE_WEIGHT, NEUTRAL_CUTOFF, WEAK_THRESHOLD = 3.0, 1.6, 1.5, 0.15, 0.60
CLAUSE_WEIGHTS = {
    "prefer_after_clause": (0.75, 1.25),
    "subordinate_before_clause": (0.85, 1.15),
    "amplify_negative_after": (None, 1.2),
    "amplify_positive_after": (None, 1.2),
    "contradict_expectation": (None, 1.15),
}
RULE_CONTRACT = "2.0.0"

# Uncertainty weights, fusion policy and their search grids.
UNCERTAINTY_WEIGHTS = {"wc": 0.4, "wm": 0.4, "wd": 0.2}
WEIGHT_GRID = ((0.50, 0.30, 0.20), (0.40, 0.40, 0.20), (0.45, 0.25, 0.30), (0.34, 0.33, 0.33))
HIGH_CONFIDENCE, REVIEW = 0.80, 0.70
HIGH_GRID, REVIEW_GRID = (0.70, 0.75, 0.80, 0.85), (0.50, 0.60, 0.70, 0.80)
THRESHOLD_GRID = (0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85)
MIN_PRECISION, MIN_COVERAGE, PREFERRED_THRESHOLD = 0.95, 0.30, 0.60
RULE_ALPHA, SIMILARITY_BETA = 0.35, 0.35

ECE_BINS, PROBABILITY_EPS = 10, 1e-12
TEMPERATURE_GRID = (0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0, 4.0, 5.0, 10.0)
EMBEDDING_DIM, CLUSTER_SIMILARITY, MIN_CLUSTER = 128, 0.72, 3
TOP_KEYWORDS, TOP_LOCATIONS, SAMPLE_DOCS = 10, 5, 3
SPAN_MIN, SPAN_MAX = 35, 320
FOLDS, SEED = 6, 42

# Words and forms that the text functions compare.
TOKEN = r"[A-Za-zÀ-ſ]+(?:['\-][A-Za-zÀ-ſ]+)*"
NEGATIONS = {
    "gak": "tidak", "ga": "tidak", "gk": "tidak", "nggak": "tidak", "enggak": "tidak", "ngga": "tidak", "tdk": "tidak", "kagak": "tidak", "ndak": "tidak", "tak": "tidak",
    "bkn": "bukan", "bukn": "bukan", "blm": "belum", "blom": "belum", "belom": "belum", "jgn": "jangan", "jngn": "jangan",
}
TRACKING = ("_ga", "fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "trk", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term", "ref")
ABBREVIATIONS = frozenset(
    "adm bpk buk cv dll dkk dr ds dst fig jl kab kec kel no pt rt rw s.d sd smp sma smk st tbk yth".split()
)
