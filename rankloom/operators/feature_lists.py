"""The feature columns of each model schema version, in model order."""

from __future__ import annotations

from rankloom.operators import page_features as pf

# --- fixed values -----------------------------------------------------------
BASELINE_COLUMNS = (
    "text_length_chars", "html_length_chars", "word_count", "unique_word_count", "unique_word_ratio", "avg_word_length", "sentence_count",
    "avg_sentence_length", "paragraph_count", "h1_count", "h2_count", "h3_count", "heading_count", "title_present", "title_length",
    "meta_description_present", "meta_description_length", "query_in_title", "query_in_text", "exact_query_count", "query_term_count",
    "title_query_term_count", "meta_query_term_count", "title_keyword_coverage_ratio", "meta_keyword_coverage_ratio",
    "query_terms_in_headings", "heading_query_coverage_ratio", "first_200_words_query_term_count", "query_density", "keyword_coverage_ratio",
    "link_count", "image_count", "list_item_count", "strong_tag_count", "form_count", "input_count", "inputs_per_form_ratio",
    "avg_paragraph_length", "link_density_per_1000_words", "image_density_per_1000_words", "list_density_per_1000_words",
    "strong_density_per_1000_words", "text_to_html_ratio", "semantic_similarity", "early_query_coverage_ratio", "conversion_signal_score",
    "content_link_ratio", "heading_paragraph_balance", "query_semantic_alignment", "title_semantic_alignment", "heading_semantic_alignment",
    "title_heading_keyword_alignment", "content_depth_semantic_score", "query_prominence_score", "title_length_quality",
    "meta_length_quality", "keyword_balance_score", "semantic_content_richness", "cta_semantic_score",
)
# --- end of fixed values ----------------------------------------------------

FEATURE_COLUMNS = {"v1": BASELINE_COLUMNS}
FEATURE_COLUMNS["v2"] = (*BASELINE_COLUMNS, *pf.TECHNICAL_COLUMNS, *pf.COMMERCIAL_COLUMNS)
FEATURE_COLUMNS["v3"] = (*FEATURE_COLUMNS["v2"], *pf.HEAVY_COLUMNS, *pf.ALIGNMENT_COLUMNS)
FEATURE_COLUMNS["v4"] = (*FEATURE_COLUMNS["v3"], *pf.CORE_COLUMNS)


def feature_columns(version: str) -> tuple[str, ...]:
    if version not in FEATURE_COLUMNS:
        raise ValueError(f"unknown feature schema version {version!r}; known are {', '.join(FEATURE_COLUMNS)}")
    return FEATURE_COLUMNS[version]
