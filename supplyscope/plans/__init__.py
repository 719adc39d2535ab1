"""Execution patterns shared by the operators: written tables, ordered work, hot keys."""
