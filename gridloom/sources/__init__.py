"""Readers and writers of images, maps, landmarks and settings."""
