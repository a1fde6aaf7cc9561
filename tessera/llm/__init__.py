"""Corpus preparation for language-model training: ten operators, their queries and the pipeline over them."""
