"""Presets, registries of pipelines, and the lifecycle from named sources to batches."""
