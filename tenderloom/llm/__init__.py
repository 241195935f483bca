"""Operators for preparing training text: formatting, scoring, matching and tokenizing documents."""
