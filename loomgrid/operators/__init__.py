"""Relational and window operators over (timestamp, entity) panels."""
