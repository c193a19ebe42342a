"""The same plans over streams of sources."""
