"""Event-time streams (an extension beyond the reference)."""
