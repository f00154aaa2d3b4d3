"""Registered queries and the SQL they are held against."""

from framelode.plans import answers, chunks, coercion, cuts, entities, faces, retrieval, selection, timeline, units  # noqa: F401
