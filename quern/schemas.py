"""Tables, enumerations and fixed values of the interview domain."""

from __future__ import annotations

# Thresholds and names that results depend on.
LEAST_CHARS, LEAST_WORDS = 50, 8
LANGUAGES = ("ca", "es")  # in the order that breaks ties
#: The codes by which a translation model knows the languages.
MODEL_LANGUAGES = {"ca": "cat_Latn", "es": "spa_Latn"}
TARGET_LANGUAGE = "es"
RATIO_LOW, RATIO_HIGH = 0.4, 3.0
REPEAT_SIZE, REPEAT_LEAST = 3, 6
SIMILARITY_BOUND = 0.50
ROUND_TRIP_SAMPLE = 100
CHUNK_WORDS, CHUNK_TOKENS = 150, 512
SENTENCE_CHARS, LEGACY_CHUNK_CHARS, DETECT_CHARS, CLASSIFY_CHARS = 150, 4000, 500, 512
MOST_FAILED_BATCHES = 3
CONFUSED_ABOVE = 0.6
SHORT_TOKENS, COVERAGE = 4, 0.25
LEAST_TOPIC_DOCS, TOPIC_WORDS, TOPIC_SEED = 10, 10, 42
NGRAM_RANGE, MAX_DF, MIN_DF = (1, 2), 0.85, 2
EVALUATION_TOP, EVALUATION_SEEDS = 10, (0, 21, 42, 84, 123)
POSITIVE_ABOVE, NEGATIVE_BELOW = 3.5, 2.5
GENERATION_VERSION, RETRY_GENERATION_VERSION = "1", "1-retry"

PROVENANCES = ("SOURCE_ES", "CACHE_HIT", "FRESH_OK", "RETRY_OK", "FAILED", "REPETITION_REPAIRED")
USABLE_STATUSES = ("IDENTITY_COPY", "CACHE_HIT", "TRANSLATED")
SENTIMENT_LABELS = {1: "VERY_NEGATIVE", 2: "NEGATIVE", 3: "NEUTRAL", 4: "POSITIVE", 5: "VERY_POSITIVE"}

CORPUS = "map<string, map<string, string>>"
RESPONSES_IN = "interview_id string, question_id string, original_text string"
MEMORY = (
    "model string, generation_version string, source_language string, target_language string, source_hash string, "
    "source_text string, translated_text string, engine string, engine_version string, created_at timestamp"
)
CHECK = "detected_language: string, confidence: double, passed: boolean, status: string"
DEGENERATE = (
    "is_empty: boolean, is_identical_to_source: boolean, is_identical_to_source_fatal: boolean, repetition_flag: boolean, "
    "repetition_detail: struct<ngram: string, count: int>, flagged: boolean"
)
LENGTHS = (
    "source_chars: int, target_chars: int, source_tokens: int, target_tokens: int, "
    "char_ratio: double, token_ratio: double, length_ratio_outlier: boolean"
)
TOPICS = "topic string, words array<string>, scores array<double>, count bigint, topic_group string"
TOPIC_RESULT = (
    "algorithm string, group string, scope string, metadata struct<document_count: bigint>, "
    "diagnostics struct<outlier_percentage: double, topic_size_distribution: map<string, bigint>>, "
    "topics map<string, struct<words: array<string>, scores: array<double>, count: bigint, group: string>>"
)
