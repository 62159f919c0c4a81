"""Scalar building blocks: hashing, cutting, features, payload codecs."""
