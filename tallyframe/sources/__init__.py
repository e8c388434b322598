"""Readers, writers and facts about files."""
