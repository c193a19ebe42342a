"""From a checked document to DataFrame plans."""
