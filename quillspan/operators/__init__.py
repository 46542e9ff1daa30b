"""Operators over tables of pages, words, regions, blocks and cells."""
