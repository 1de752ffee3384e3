"""Operators on relations of pixels, scores and warps."""
