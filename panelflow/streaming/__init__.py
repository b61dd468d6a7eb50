"""Structured Streaming variants of the hourly roll-up and gap filter."""
