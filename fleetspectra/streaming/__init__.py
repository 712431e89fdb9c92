"""Spectra over arriving signals."""
