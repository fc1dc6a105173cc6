"""Closed label domains, alias tables, word lists and thresholds.

Fixed values: results depend on them, so they are listed here plainly and used from here only.
"""

from __future__ import annotations

PREDICTABILITY = ("predictable", "underdetermined", "unpredictable")

QUESTION_TYPES = (
    "what_happens_next",
    "what_changes_next",
    "what_is_revealed_next",
    "what_text_appears_next",
)

TARGET_TYPES = (
    "action_transition",
    "state_change",
    "participant_update",
    "spatial_consequence",
    "object_reveal",
    "visible_text_update",
)

CONTINUITY_TYPES = (
    "continuous_physical",
    "continuous_social",
    "dialogue_continuous",
    "scene_cut_semantically_linked",
    "discontinuous_unpredictable",
)

EVIDENCE_TYPES = (
    "physical_precondition",
    "motion_trajectory",
    "object_affordance",
    "social_cue",
    "dialogue_cue",
    "emotional_cue",
    "scene_script",
    "hazard_cue",
    "other",
)

REASONING_TYPES = (
    "physical_precondition",
    "motion_trajectory",
    "object_affordance",
    "social_interaction",
    "dialogue_grounded",
    "intent_driven",
    "scene_script",
    "hazard_prediction",
    "other",
)

DISTRACTOR_TYPES = (
    "correct",
    "already_happened",
    "entity_swapped",
    "plausible_unsupported",
    "contradicts_context",
    "unrelated",
)

QUESTION_TYPE_OF_TARGET = {
    "action_transition": "what_happens_next",
    "participant_update": "what_happens_next",
    "spatial_consequence": "what_happens_next",
    "state_change": "what_changes_next",
    "object_reveal": "what_is_revealed_next",
    "visible_text_update": "what_text_appears_next",
}

EVIDENCE_ALIASES = {
    "emotion_cue": "emotional_cue",
    "emotion_driven": "emotional_cue",
    "social_interaction": "social_cue",
    "hazard_prediction": "hazard_cue",
    "intent_driven": "scene_script",
}

REASONING_ALIASES = {
    "social_cue": "social_interaction",
    "emotional_cue": "social_interaction",
    "emotion_cue": "social_interaction",
    "emotion_driven": "social_interaction",
    "hazard_cue": "hazard_prediction",
    "dialogue_cue": "dialogue_grounded",
    "spatial_setup": "physical_precondition",
}

PHYSICAL_REASONING = (
    "physical_precondition",
    "motion_trajectory",
    "object_affordance",
    "scene_script",
    "hazard_prediction",
)
SOCIAL_REASONING = ("social_interaction", "intent_driven")

TRIVIAL = (
    "trivial_generic_motion",
    "trivial_static_state",
    "trivial_redundant_continuation",
    "trivial_low_information",
)

KEPT_CONTINUITY = ("continuous_physical", "continuous_social")

FRAGMENT_STARTS = ("knocking", "sending", "causing", "making", "leaving", "revealing", "showing", "then")
PRONOUN_STARTS = ("he", "she", "it", "they", "his", "her", "their")

FEATURE_STOPWORDS = (
    "a", "an", "and", "are", "at", "be", "by", "for", "from", "he", "her", "hers", "him", "his", "in", "is",
    "it", "its", "of", "on", "she", "that", "the", "their", "them", "they", "this", "to", "was", "were", "with",
)

PEOPLE_WORDS = ("man", "woman", "he", "she", "they", "someone", "waiter", "couple")

LOCATION_WORDS = (
    "door", "hall", "hallway", "room", "street", "kitchen", "table", "car", "bed", "stairs", "office", "bar",
    "restaurant",
)

ACTION_WORDS = (
    "open", "close", "walk", "run", "sit", "stand", "turn", "look", "pick", "hold", "raise", "unlock", "enter",
    "leave", "hand", "give", "take", "search", "pull", "push", "step", "approach", "say", "ask", "smile", "stop",
    "drink", "eat", "drive", "knock", "call",
)

OVERLAP_STOPWORDS = (
    "a", "an", "the", "and", "or", "of", "in", "on", "at", "to", "is", "are", "with", "for", "into", "from", "by",
    "as", "his", "her", "their", "they", "he", "she", "it", "its", "this", "that", "these", "those", "be", "been",
    "but", "off", "out", "up", "over", "while", "then", "next", "now",
)

CONCRETE_TARGET_TYPES = ("object_reveal", "spatial_consequence", "state_change", "participant_update")

#: idf of a token seen on one side only (natural log of 2, to the digits in use).
ONE_SIDED_IDF = 1.69314718056

QUALITY_THRESHOLD = 0.7
EXPECTEDNESS_RANGE = (0.4, 0.8)
MIN_BLOCK_CHARS = 20
MATCH_TOLERANCE = 0.02
TEXT_MATCH_LIMIT = 6.0
NEAREST_LIMIT = 0.4

#: Header aliases of a clip row, in order of precedence.
CLIP_COLUMN_ALIASES = {
    "movie": ("movie", "movie_id", "video_id", "imdb"),
    "clip_id": ("clip_id", "clip", "id", "segment_id"),
    "timestamp_start": ("timestamp_start", "start", "start_time"),
    "timestamp_end": ("timestamp_end", "end", "end_time"),
    "audio_description": ("audio_description", "description", "sentence", "caption", "text"),
    "video_path": ("video_path", "video"),
}

#: Substrings (lower case) that quarantine a text, and markers of lines that are let through.
PRIVATE_SUBSTRINGS = ("/users/", "openai_api_key", "api_key:", "access_token", "secret_key")
ALLOWED_LINE_MARKERS = ("todo(author)", "private path", "raw source")
