"""Schemas, configuration and stored inputs."""
