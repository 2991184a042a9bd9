"""Readers of source payloads and writers of exports."""
