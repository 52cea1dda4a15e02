"""Compositions of operators: monitoring report, training, explanation, incidents."""
