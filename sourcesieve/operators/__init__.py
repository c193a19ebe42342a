"""Scanning, parsing, scope, rules and order of diagnostics."""
