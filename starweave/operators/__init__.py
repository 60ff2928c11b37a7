"""Data jobs: profiling, candidate keys, model inference, split and quality checks."""
