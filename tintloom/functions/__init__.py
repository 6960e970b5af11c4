"""Scalar functions: colour spaces, optical density, names."""
