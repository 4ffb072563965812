"""End-to-end runs: adapters to the test tables, updates, evaluation, analysis."""
