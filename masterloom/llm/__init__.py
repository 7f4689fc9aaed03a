"""Operators for building training data from text: language, duplicates,
mixing, chat formatting, tokenisation and scoring."""
