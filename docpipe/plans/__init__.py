"""Whole stages as lazy plans: silver, gold, batches, questions and their sinks."""
