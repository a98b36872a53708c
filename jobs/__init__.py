"""Runnable jobs: ``python -m jobs.<name> --config jobs/<name>.json``; each job's work is a function that takes a session."""
