"""Compositions of operators: collect, label, report."""
