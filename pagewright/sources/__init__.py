"""Readers, and adapters from plain tables to the operators' inputs."""
