"""Whole plans composed of operators."""
