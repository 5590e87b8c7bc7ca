"""DataFrame -> DataFrame operators (text, profiles, similarity, CF, topics)."""
