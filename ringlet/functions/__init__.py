"""Subpackage of ringlet."""
