"""Operators for preparing language-model training text, their registered queries and the corpus pipeline's stages."""
