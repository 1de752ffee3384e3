"""Whole queries: frames of images through scoring, alignment and fusion."""
