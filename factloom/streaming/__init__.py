"""Structured Streaming: uploads, lifecycles, throttles, findings and case states as they arrive."""
