"""Renderings of the engine's rows for other programs."""
