"""Live tail and rules on Structured Streaming."""
