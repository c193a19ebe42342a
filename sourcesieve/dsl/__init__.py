"""The rule language: text to a checked document."""
