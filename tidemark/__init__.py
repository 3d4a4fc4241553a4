"""Spark-first signal analytics: segments, spectra, features, onsets, state models and maps as DataFrame plans."""
