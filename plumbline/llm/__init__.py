"""Operators on texts and duplicate groups for language-model data; nothing outside imports this."""
