"""Operators over slides, tiles and pixels."""
