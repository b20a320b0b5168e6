"""Runnable jobs. Each is a module with a function that takes a session, and a command line."""
