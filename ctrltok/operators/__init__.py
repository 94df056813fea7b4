"""DataFrame -> DataFrame operators (features, corpora, profiles, audits, metrics)."""
