"""Fixed values that results depend on."""

# Category to axis.
AXIS_MAP = {
    "disability_status": "disability_status",
    "gender_identity": "gender_identity",
    "nationality": "nationality",
    "physical_appearance": "physical_appearance",
    "race_ethnicity": "race_ethnicity",
    "race_x_gender": "race_ethnicity",
    "race_x_ses": "race_ethnicity",
    "religion": "religion",
    "sexual_orientation": "sexual_orientation",
    "ses": "socioeconomic_status",
    "socioeconomic_status": "socioeconomic_status",
}

# Entity-id prefix to axis.
AXIS_PREFIX_MAP = {
    "disability": "disability_status",
    "gender": "gender_identity",
    "sex": "gender_identity",
    "appearance": "physical_appearance",
    "race": "race_ethnicity",
    "religion": "religion",
    "sexuality": "sexual_orientation",
    "ses": "socioeconomic_status",
    "nationality": "nationality",
    "age": "age",
}

# Answers that mean "not known".
UNKNOWN_ALIASES = [
    "unknown", "not answerable", "can't answer", "cannot answer", "can't be determined",
    "cannot be determined", "not enough information", "not known", "not applicable",
]

# Hand-written label aliases, applied after those of the forms table.
MANUAL_ALIASES = {
    "disabled": "disability_disabled",
    "physically disabled": "disability_physically_disabled",
    "wheelchair": "disability_physically_disabled",
    "nondisabled": "disability_nondisabled",
    "nondisabled person": "disability_nondisabled",
    "non disabled": "disability_nondisabled",
    "able bodied": "disability_able_bodied",
    "man": "gender_man",
    "m": "gender_man",
    "male": "gender_man",
    "woman": "gender_woman",
    "f": "gender_woman",
    "female": "gender_woman",
    "fat": "appearance_obese",
    "obese": "appearance_obese",
    "nonobese": "appearance_thin",
    "non obese": "appearance_thin",
    "slim": "appearance_thin",
    "thin": "appearance_thin",
    "black": "race_black",
    "african american": "race_black",
    "white": "race_white",
    "caucasian": "race_caucasian",
    "asian": "race_asian",
    "hispanic": "race_hispanic",
    "latino": "race_latino",
    "native american": "race_native_american",
    "muslim": "religion_muslim",
    "jewish": "religion_jewish",
    "christian": "religion_christian",
    "gay": "sexuality_gay",
    "straight": "sexuality_straight",
    "heterosexual": "sexuality_heterosexual",
    "lesbian": "sexuality_lesbian",
    "bisexual": "sexuality_bisexual",
    "low ses": "ses_low_income",
    "low socioeconomic status": "ses_low_income",
    "low income": "ses_low_income",
    "poor": "ses_low_income",
    "lowses": "ses_low_income",
    "rich": "ses_rich",
    "high socioeconomic status": "ses_high_socioeconomic_status",
    "highses": "ses_high_socioeconomic_status",
    "upper class": "ses_upper_class",
    "lower class": "ses_lower_class",
    "old": "age_old",
    "nonold": "age_nonold",
    "non old": "age_nonold",
    "african": "race_black",
    "arab": "race_arab",
    "asia pacific": "nationality_asia_pacific",
    "asiapacific": "nationality_asia_pacific",
    "africa": "nationality_african",
    "europe": "nationality_european",
}

# Short forms inside compound labels.
COMPONENT_EXPANSIONS = {"f": "female", "m": "male"}

# Awkward phrases the prompt lint looks for.
BAD_PATTERNS = [
    "has is", "has has", "is is", "A a", "A an", "One a", "One an", "The a", "The an", "people are people",
]

# Words ignored when taking content terms from a question.
STOPWORDS = [
    "who", "what", "when", "where", "why", "how", "was", "were", "is", "are", "the", "a", "an", "to", "of",
    "in", "on", "for", "and", "or", "likely", "had", "has", "have",
]
# Extra stopwords of the token-level variant.
STOPWORDS_TOKEN_EXTRA = ["did", "does"]

# Words that mark a token as template wording.
TEMPLATE_WORDS = [
    "person", "individual", "someone", "somebody", "people", "group", "community",
    "identity", "descriptor", "demographic", "attribute", "label", "category",
    "described", "describes", "mentioned", "refers", "example", "sentence",
    "this", "that", "these", "those", "the", "a", "an", "is", "are", "was",
    "were", "will", "be", "has", "have", "had", "from", "with", "belongs",
    "associated", "applies", ".", ",", ":", ";",
]

# Sub-word markers removed from token text.
SUBWORD_MARKERS = "Ġ▁"

# Triage roles.
ROLE_ORDER = [
    "identity_token_local",
    "sentence_final_integrated",
    "contrast_specific_identity",
    "shared_social_feature",
    "template_or_syntax_artifact",
    "polysemantic_or_unclear",
    "low_signal",
]

# Order of priorities; anything else sorts as 9.
PRIORITY_ORDER = {"high": 0, "medium": 1, "low": 2}

# Canonical metric columns and the names accepted for them.
METRIC_ALIASES = {
    "cosine_with_direction": ["decoder_cosine_with_direction", "decoder_cosine", "cosine", "decoder_alignment"],
    "feature_id": ["feature", "sae_feature", "sae_feature_id"],
    "contrast_name": ["contrast", "contrast_id"],
    "combined_score": ["score", "candidate_score"],
    "auc": ["auc_identity_vs_other_same_axis", "roc_auc"],
}
METRIC_NUMERIC = ["layer", "feature_id", "cohens_d", "auc", "diff_mean", "cosine_with_direction", "combined_score", "decoder_cosine"]

# Canonical token columns and the names accepted for them.
TOKEN_ALIASES = {
    "feature_id": ["feature", "sae_feature", "sae_feature_id"],
    "prompt_id": ["row_idx", "prompt_index", "example_id"],
    "token_str": ["token", "token_string", "str_token"],
    "token_feature_activation": ["activation", "feature_activation", "value"],
    "is_identity_span_token": ["inside_identity_span", "identity_span_token", "is_identity_token"],
    "canonical_label": ["identity_label", "label"],
    "template_id": ["template", "template_name"],
    "final_token_feature_activation": ["final_activation", "final_token_activation"],
}
TOKEN_NUMERIC = ["layer", "feature_id", "token_idx", "token_feature_activation", "final_token_feature_activation"]
