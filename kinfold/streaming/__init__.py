"""Extension: the same counts over a stream of commits."""
