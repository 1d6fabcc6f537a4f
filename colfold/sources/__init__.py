"""Readers, samples and the folded file formats."""
