"""Operators: splitting, tokens, rules, measures, scores."""
