"""Structured Streaming: the live monitor and the adaptive check of a device."""
