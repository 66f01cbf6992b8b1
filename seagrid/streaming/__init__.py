"""Streams of points against static fields."""
