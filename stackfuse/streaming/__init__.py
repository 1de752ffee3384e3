"""Stacks that arrive frame by frame."""
