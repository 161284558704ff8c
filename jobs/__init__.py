"""Runnable jobs: each has a function taking a session, a command line and a small config file."""
