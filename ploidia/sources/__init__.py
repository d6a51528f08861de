"""Readers, discovery and validation of inputs."""
