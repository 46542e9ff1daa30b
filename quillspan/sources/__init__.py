"""Readers that turn files into typed tables, and writers back."""
