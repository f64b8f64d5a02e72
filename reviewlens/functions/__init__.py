from .text import (  # noqa: F401
    clamp01, clean_light, clean_ml, confidence_pct, is_ascii, label_text, letters_only,
    nfkc, nfkc_delta, raw_tokens, strip_mentions, strip_urls, text_lower, tfidf_terms, to_count, words,
)
