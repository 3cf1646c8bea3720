"""Configured runs: settings from files and the command line, steps in their order."""
